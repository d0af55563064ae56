"""The best pairs of records by the n-grams of two fields, name and address, without a product for every pair of records.

N-grams lie within words, so a text's vector is the sum of its words' vectors.  A task
holds a block of queries and all records of the other side, as texts.  Names are
multiplied once for each pair of different names.  Texts of addresses fall into patterns
(their frequent words); the product with a pattern and the best of the rare words bound
an address, and an address is multiplied only where the bound, with the name, reaches
the k-th best score found so far.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..sources.sinks import scratch

#: Queries in one task at most and at least, those handled at a time, pairs of names held, others met at first and patterns of a task.
MOST, LEAST, ROWS, NAMES, FIRST, PATTERNS = 1 << 16, 1 << 11, 128, 12_000_000, 64, 2048
#: Pairs of a row and an other met at a time, pairs of words held, names from which the first others come, the cosine below which a name is a poor guide, and the part of the best reach (one in LEVELS less) that comes first.
CELLS, TABLE, FEW, POOR, LEVELS, STEP = 1 << 18, 160_000_000, 512, 0.6, 8, 2048
#: Others that are met by their names at least, and the part of the main rare word that tells enough.
NEAR, ALONE = 8192, 0.6
#: Dense columns for a product of names, the share of all pairs that must have a key for one to pay, and products added at a time.
DENSE, SHARE, POSTINGS = 512, 50, 1 << 22
SHIFT, NINE, SLACK = 32, 1e9, 3e-9
REPEATED = re.compile("([^\\n\\r\\u0085\\u2028\\u2029])\\1+")
GRAMS = {"name": (2, 4), "addr": (3, 4)}
#: The weight with which the address decides.
BY_ADDRESS = 1000.0
WAYS = "s1 {}, tgt {}, name_cos double, addr_cos double, score double, addr_score double, way string, rank int"


def grams_of(word: str, low: int, high: int) -> list[str]:
    """``vectors.word_grams`` of one word of a squashed text."""
    padded = f" {REPEATED.sub(r'\1', word)} "
    size = len(padded)
    return [g for n in range(low, high + 1) for g in ([padded[i : i + n] for i in range(size - n + 1)] if size > n else [padded] if n == low or n == size else [])]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each part, one part after another."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def by_postings(rows: np.ndarray, w: np.ndarray, first: np.ndarray, size: np.ndarray, to: np.ndarray, more: np.ndarray | None, n: int, m: int) -> np.ndarray:
    """A table of n rows and m columns: each entry (row, weight) added to the columns of its postings, times their own weight."""
    total, out = np.cumsum(size), np.zeros(n * m)
    for lo in range(0, int(total[-1]) if len(total) else 0, POSTINGS):
        a, z = np.searchsorted(total, (lo, lo + POSTINGS), "right")
        at = spread(first[a:z], size[a:z])
        part = np.repeat(w[a:z], size[a:z])
        out += np.bincount(np.repeat(rows[a:z] * m, size[a:z]) + to[at], part if more is None else part * more[at], n * m)
    return out.reshape(n, m)


class Words:
    """The different words of texts, with their grams; a word and a gram that are the same string have one key."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.known, self.keys = low, high, {}, {}
        self.grams: list[list[int]] = []
        self.own: list[int] = []

    def _key(self, text: str) -> int:
        return self.keys.setdefault(text, len(self.keys))

    def _word(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.grams)
            self.grams.append([self._key(g) for g in grams_of(word, self.low, self.high)])
            self.own.append(self._key(word))
        return at

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of the texts, one text after another, and where each text begins (and the last ends)."""
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        known = np.array([self._word(w) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        word, text = known[coded.indices.to_numpy()], np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        size = np.bincount(text[word >= 0], minlength=len(texts))
        return word[word >= 0], np.concatenate([[0], np.cumsum(size)])

    def close(self) -> None:
        self.size = np.fromiter(map(len, self.grams), np.int64, len(self.grams))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.fromiter((k for g in self.grams for k in g), np.int64, int(self.size.sum()))
        self.own_key = np.array(self.own, np.int64)

    def entries(self, words: np.ndarray, begin: np.ndarray, rows: np.ndarray, by_gram: np.ndarray, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, weight) of texts; a key may stand more than once."""
        size = begin[rows + 1] - begin[rows]
        row, word = np.repeat(np.arange(len(rows)), size), words[spread(begin[rows], size)]
        many = self.size[word]
        of_grams = np.repeat(row, many), self.flat[spread(self.first[word], many)]
        return np.concatenate([of_grams[0], row]), np.concatenate([of_grams[1], self.own_key[word]]), np.concatenate([by_gram[of_grams[0]], by_word[row]])


def summed(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with each key of a row once."""
    both, at = np.unique(row * n_keys + key, return_inverse=True)
    return both // max(n_keys, 1), both % max(n_keys, 1), np.bincount(at, weight, len(both))


def weights(texts: list[str], low: int, high: int, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """What a gram and what a word counts in each text's vector: n-grams of unit length plus words of unit length, then of unit length."""
    by_gram, by_word = np.zeros(len(texts)), np.zeros(len(texts))
    for lo in range(0, len(texts), step):
        part = Words(low, high)
        words, begin = part.texts(texts[lo : lo + step])
        part.close()
        n = len(begin) - 1
        rows, ones, none = np.arange(n), np.ones(n), np.zeros(n)
        inverse = lambda v: np.divide(1, np.sqrt(v), out=np.zeros(n), where=v > 0)
        square = lambda g, w: (lambda e: np.bincount(e[0], e[2] ** 2, n))(summed(*part.entries(words, begin, rows, g, w), len(part.keys)))
        gram, word = inverse(square(ones, none)), inverse(square(none, ones))
        whole = inverse(square(gram, word))
        by_gram[lo : lo + n], by_word[lo : lo + n] = gram * whole, word * whole
    return by_gram, by_word


def measured(df: DataFrame) -> DataFrame:
    """(id, country, name, addr) with the weights of grams and words in either field."""
    def measure(batches):
        for batch in batches:
            more = {}
            for field, (low, high) in GRAMS.items():
                coded = batch[field].dictionary_encode()
                for kind, w in zip("gw", weights(coded.dictionary.to_pylist(), low, high)):
                    more[f"{field}_{kind}"] = pa.array(w[coded.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    rows = df.select(F.col("entity_id").alias("id"), "country", F.coalesce("name_n", F.lit("")).alias("name"), F.coalesce("addr_n", F.lit("")).alias("addr")).where("country is not null")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", name_g double, name_w double, addr_g double, addr_w double"
    return scratch(rows.mapInArrow(measure, schema), "measured")


def search(queries: DataFrame, others: DataFrame, ways: dict[str, tuple[float, int]], weight: float, block: int | None, inner: int | None) -> DataFrame:
    """The best others of each query, for each way with its weight of the address and its k.  Either side is ``measured``.

    Queries with one name are in one block, if they are not too many for it; all others
    of the country are copied to each block.
    """
    if block is None:
        block = max(LEAST, min(MOST, -(-queries.count() // (2 * queries.sparkSession.sparkContext.defaultParallelism))))
    n = queries.groupBy("country").agg(F.ceil(F.count("*") / block).alias("n"))
    often = queries.groupBy("country", "name").agg(F.count("*").alias("many")).where(F.col("many") > max(1, block // 4))
    own = queries.join(F.broadcast(n), "country").join(F.broadcast(often), ["country", "name"], "left")
    apart = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / max(1, block // 4))), F.lit(0))
    own = own.withColumn("b", F.pmod(F.pmod(F.xxhash64("name"), F.col("n")) + apart, "n")).drop("n", "many")
    rest = others.join(F.broadcast(n), "country").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    parts = max(1, own.select("country", "b").distinct().count())
    own, rest = (df.repartition(4 * parts, "country", "b") for df in (own, rest))  # few tasks get two blocks
    kinds = dict(queries.dtypes)["id"], dict(others.dtypes)["id"]
    of_s1 = "b" in ways
    run = partial(_search, ways=ways, weight=weight, rows=inner or ROWS)
    found = own.groupBy("country", "b").cogroup(rest.groupBy("country", "b")).applyInArrow(lambda x, y: run(x, y), WAYS.replace("s1", "query").replace("tgt", "other").format(*kinds))
    return found.withColumnsRenamed({"query": "s1", "other": "tgt"} if of_s1 else {"query": "tgt", "other": "s1"})


class _Side:
    def __init__(self, table: pa.Table):
        self.ids = table.column("id").combine_chunks()
        coded = [table.column(c).combine_chunks().dictionary_encode() for c in ("name", "addr")]
        self.name, self.addr = (c.indices.to_numpy().astype(np.int64) for c in coded)
        self.names, self.addrs = (c.dictionary.to_pylist() for c in coded)
        of = lambda field, at, n: [self._once(table.column(f"{field}_{k}").to_numpy(), at, n) for k in "gw"]
        self.name_w, self.addr_w = of("name", self.name, len(self.names)), of("addr", self.addr, len(self.addrs))
        self.some = np.array([a != "" for a in self.addrs], bool)

    @staticmethod
    def _once(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[at] = values
        return out


def product(x, y, n: int, m: int, n_keys: int) -> np.ndarray:
    """Dot products of all rows of two blocks of entries (row, key, weight): frequent keys as dense columns, the others by their postings."""
    count_x, count_y = np.bincount(x[1], minlength=n_keys), np.bincount(y[1], minlength=n_keys)
    cost = count_x * count_y
    heavy = np.argsort(-cost, kind="stable")[:DENSE]
    heavy = heavy[cost[heavy] > n * m / SHARE]
    column = np.full(n_keys, -1)
    column[heavy] = np.arange(len(heavy))
    sides = []
    for (row, key, w), size in ((x, n), (y, m)):
        on = column[key] >= 0
        sides.append(np.bincount(row[on] * len(heavy) + column[key[on]], w[on], size * len(heavy)).reshape(size, len(heavy)))
    out = sides[0] @ sides[1].T
    order = np.argsort(y[1], kind="stable")
    to, w_y, first = y[0][order], y[2][order], np.cumsum(count_y) - count_y
    light = np.flatnonzero((column[x[1]] < 0) & (count_y[x[1]] > 0))
    if len(light):
        key = x[1][light]
        out += by_postings(x[0][light], x[2][light], first[key], count_y[key], to, w_y, n, m)
    return out


class _Addresses:
    """The different addresses of the other side by their patterns, and the products of a few queries' addresses with their words.

    A pattern is what an address has of frequent words, and how long its other (rare) words are.
    """

    def __init__(self, x: _Side, y: _Side):
        self.words = Words(*GRAMS["addr"])
        y_words, y_begin = self.words.texts(y.addrs)
        n, n_words = len(y.addrs), len(self.words.grams)  # those of the other side come first
        self.x_words, self.x_begin = self.words.texts(x.addrs)
        self.words.close()
        self.x, self.n_keys, self.n_words = x, len(self.words.keys), n_words
        size, text = np.diff(y_begin), np.repeat(np.arange(n), np.diff(y_begin))
        held, length = np.bincount(y_words, minlength=n_words), np.fromiter(map(len, self.words.known), np.int64, len(self.words.grams))[:n_words]
        lengths, of_length = np.unique(length, return_inverse=True)
        mix = np.random.default_rng(1).integers(0, 1 << 64, n_words + len(lengths) + 1, np.uint64)
        for share in (256, 64, 16, 4, 0):
            often = held > n / share if share else np.zeros(n_words, bool)
            on = often[y_words]
            mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix[np.where(on, y_words, n_words + of_length[y_words])], dtype=np.uint64)])
            mixed = mixed[y_begin[1:]] - mixed[y_begin[:-1]] + np.where(y.some, mix[-1], np.uint64(0))
            _, first, self.kind = np.unique(mixed, return_index=True, return_inverse=True)
            if len(first) <= PATTERNS:
                break
        k = len(first)
        order = np.lexsort((length, often))  # rare words by their length, then the frequent ones
        self.column = np.empty(n_words, np.int64)
        self.column[order] = np.arange(n_words)
        edges = np.searchsorted(length[order[: int((~often).sum())]], np.append(lengths, np.inf))
        self.classes = [(int(a), int(z)) for a, z in zip(edges[:-1], edges[1:])]
        rows = [y_words[y_begin[i] : y_begin[i] + size[i]] for i in first]
        self.often = self._padded([self.column[r[often[r]]].tolist() for r in rows])
        self.some = y.some[first]
        self.slots = np.array([np.bincount(of_length[r[~often[r]]], minlength=len(lengths)) for r in rows]).reshape(k, len(lengths))
        rare, rare_text = self.column[y_words[~on]], text[~on]
        self.rare_size = np.bincount(rare_text, minlength=n)
        self.rare = np.full((int(self.rare_size.max(initial=0)), n), n_words)
        self.rare[spread(np.zeros(n, np.int64), self.rare_size), rare_text] = rare
        self.by_gram, self.by_word = y.addr_w
        self.most_gram, self.most_word = np.zeros(k), np.zeros(k)
        for to, v in ((self.most_gram, self.by_gram), (self.most_word, self.by_word)):
            np.maximum.at(to, self.kind, v)
        keys, holder = self.words.flat[: self.words.size[:n_words].sum()], np.repeat(self.column, self.words.size[:n_words])
        order = np.argsort(keys, kind="stable")
        self.holder, self.holders = holder[order], np.bincount(keys, minlength=self.n_keys)
        self.first = np.cumsum(self.holders) - self.holders
        self.word_of = np.full(self.n_keys, -1)
        self.word_of[self.words.own_key[:n_words]] = self.column
        self.known, self.at = np.unique(self.x_words, return_inverse=True)
        self.table = None
        if len(self.known) * (n_words + 1) <= TABLE:
            self.table = np.empty((len(self.known), n_words + 1), np.uint8)
            for lo in range(0, len(self.known), 256):
                part = self._common(self.known[lo : lo + 256])
                if part.max(initial=0) > 255:  # long words that repeat a gram: made for each few queries
                    self.table = None
                    break
                self.table[lo : lo + 256] = part

    def _common(self, words: np.ndarray) -> np.ndarray:
        """How often grams of the words meet grams of each of the other side's words."""
        size = self.words.size[words]
        key = self.words.flat[spread(self.words.first[words], size)]
        return by_postings(np.repeat(np.arange(len(words)), size), np.ones(len(key)), self.first[key], self.holders[key], self.holder, None, len(words), self.n_words + 1)

    def _padded(self, lists: list[list[int]]) -> np.ndarray:
        out = np.full((len(lists), max(map(len, lists), default=0)), self.n_words)
        for i, l in enumerate(lists):
            out[i, : len(l)] = l
        return out

    def meet(self, addrs: np.ndarray) -> None:
        """Products of the queries' addresses with all words (real: for their grams, imaginary: for the words themselves) and patterns, and the most that an address of a pattern can reach."""
        n, m = len(addrs), self.n_words + 1
        size = self.x_begin[addrs + 1] - self.x_begin[addrs]
        row, place = np.repeat(np.arange(n), size), spread(self.x_begin[addrs], size)
        by_gram, by_word = (w[addrs] for w in self.x.addr_w)
        if self.table is None:
            known, at = np.unique(self.x_words[place], return_inverse=True)
            table = self._common(known)
        else:
            table, at = self.table, self.at[place]
        common, slot = np.zeros((n, m), np.float32 if self.table is not None else float), spread(np.zeros(n, np.int64), size)
        for s in range(int(size.max(initial=0))):
            on = slot == s
            common[row[on]] += table[at[on]]
        self.both = np.zeros((n, m), complex)
        np.multiply(common, by_gram[:, None], out=self.both.real)
        own = self.words.own_key[self.x_words[place]]
        many = self.holders[own]
        np.add.at(self.both.real, (np.repeat(row, many), self.holder[spread(self.first[own], many)]), np.repeat(by_word[row], many))
        r, key, w = self.words.entries(self.x_words, self.x_begin, addrs, by_gram, by_word)
        on = self.word_of[key] >= 0
        np.add.at(self.both.imag, (r[on], self.word_of[key[on]]), w[on])
        self.of_kind = sum((self.both[:, self.often[:, j]] for j in range(self.often.shape[1])), np.zeros((n, len(self.often)), complex))
        self.plain = self.most_gram * self.of_kind.real + self.most_word * self.of_kind.imag
        self.top_gram, self.top_word = (np.stack([t[:, a:z].max(1, initial=0) for a, z in self.classes], 1) if self.classes else np.zeros((n, 0)) for t in (self.both.real, self.both.imag))
        self.most = np.minimum(1, self.plain + self.most_gram * (self.top_gram @ self.slots.T) + self.most_word * (self.top_word @ self.slots.T)) + SLACK

    def cells(self, row: np.ndarray, addr: np.ndarray) -> np.ndarray:
        """The cosines of pairs (a row of ``meet``, an address)."""
        found = self.of_kind.ravel().take(row * self.of_kind.shape[1] + self.kind[addr])
        flat, begin = self.both.ravel(), row * self.both.shape[1]
        for rare in self.rare[: int(self.rare_size[addr].max(initial=0))]:
            found += flat.take(begin + rare[addr])
        return self.by_gram[addr] * found.real + self.by_word[addr] * found.imag


def _search(x: pa.Table, y: pa.Table, ways: dict[str, tuple[float, int]], weight: float, rows: int) -> pa.Table:
    """The best others of a block of queries."""
    kind = lambda t: t.column("id").type if t.num_columns else pa.string()
    schema = pa.schema([("query", kind(x)), ("other", kind(y))] + [(c, pa.float64()) for c in ("name_cos", "addr_cos", "score", "addr_score")] + [("way", pa.string()), ("rank", pa.int32())])
    if not x.num_rows or not y.num_rows:
        return schema.empty_table()
    y = y.take(pc.sort_indices(y.column("id")))  # a lower place is the better one of equal scores
    left, right = _Side(x), _Side(y)
    addresses = _Addresses(left, right)
    others = _Others(right, addresses)
    names = Words(*GRAMS["name"])
    words_y, begin_y = names.texts(right.names)
    words_x, begin_x = names.texts(left.names)
    names.close()
    n_keys, m = len(names.keys), len(right.names)
    entries_y = summed(*names.entries(words_y, begin_y, np.arange(m), *right.name_w), n_keys)
    found = []
    step = max(1, NAMES // m)
    by_name = np.argsort(left.name, kind="stable")
    for lo in range(0, len(left.names), step):
        some = np.arange(lo, min(len(left.names), lo + step))
        table = np.empty((len(some), m))
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            table[a : a + len(part)] = product(summed(*names.entries(words_x, begin_x, part, left.name_w[0][part], left.name_w[1][part]), n_keys), entries_y, len(part), m, n_keys)
        own = by_name[np.searchsorted(left.name[by_name], lo) : np.searchsorted(left.name[by_name], lo + len(some))]
        top = table.max(1)
        for a in range(0, len(own), rows):
            chunk = own[a : a + rows]
            addresses.meet(left.addr[chunk])
            block = _Block(addresses, table, left.name[chunk] - lo, top, left.some[left.addr[chunk]], others)
            for way, (w, k) in ways.items():
                row, place, rank = block.best(w, k)
                n, c = table[block.name[row], right.name[place]], addresses.cells(row, right.addr[place])
                lengths = [(left.some[left.addr[chunk[row]]], right.some[right.addr[place]], v) for v in (weight, BY_ADDRESS)]
                score, by_address = ((n + v * v * c) / (np.sqrt(1 + v * v * s) * np.sqrt(1 + v * v * o)) for s, o, v in lengths)
                found.append(pa.table([left.ids.take(pa.array(chunk[row])), y.column("id").take(pa.array(place)).combine_chunks(), *map(pa.array, (n, c, score, by_address)), pa.array([way] * len(row), pa.string()), pa.array(rank.astype(np.int32))], schema=schema))
    return pa.concat_tables(found)


class _Block:
    """A few queries, sorted by name, and all others sorted by the pattern of their address."""

    def __init__(self, addresses: _Addresses, table: np.ndarray, name: np.ndarray, top: np.ndarray, some: np.ndarray, others: "_Others"):
        self.addresses, self.table, self.name, self.top, self.others = addresses, table, name, top[name], others
        self.some, self.n = some, len(name)

    def best(self, weight: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, rank) of the k best of each row.

        A few likely others come first and give a floor.  Then come all that can reach
        it: those with the likest names by name, all others by their rare words.
        """
        of = self.addresses
        self.square = square = weight * weight
        self.length = np.sqrt(1 + square * self.some)[:, None] * np.sqrt(1 + square * of.some)
        self.found, self.floor = np.full((self.n, k), -1, np.int64), np.full(self.n, -1.0)
        words = self.some & (square > 100)
        most, done = self.top.copy(), np.zeros(of.most.shape, bool)  # of the names that are left; patterns that need no more
        edge = np.append(np.flatnonzero(np.append(True, self.name[1:] != self.name[:-1])), self.n)
        for a, z in zip(edge[:-1], edge[1:]):
            rows = np.arange(a, z)[~words[a:z]]
            if len(rows):
                most[rows], done[rows] = self._by_name(rows, self.table[self.name[a]])
        if words.any():
            self._likely(np.flatnonzero(words))
        self._by_words(most, done)
        best = -np.sort(-self.found, axis=1)
        row, rank = np.nonzero(best >= 0)
        return row, (1 << SHIFT) - 1 - (best[row, rank] & ((1 << SHIFT) - 1)), rank

    def _by_name(self, rows: np.ndarray, names: np.ndarray) -> tuple[float, np.ndarray]:
        """Others of rows with one name, by their names: the likest ones, and all where a pattern's frequent words are enough for less.

        Comes back with what names are left at most, and the patterns of which nothing is left.
        """
        of, o = self.addresses, self.others
        first = np.argpartition(-names, FEW)[:FEW] if len(names) > FEW else np.arange(len(names))
        first = first[np.argsort(-names[first], kind="stable")]
        total = np.cumsum(o.name_size[first])
        left = least_near = names[first[min(len(first) - 1, int(np.searchsorted(total, NEAR)))]]
        if o.name_size[names >= left].sum() > 4 * NEAR:  # too many are as like as that
            least_near = names.min(where=names > left, initial=np.inf)
        first = first[: int(np.searchsorted(total, FIRST)) + 1]
        columns = o.by_name[spread(o.name_first[first], o.name_size[first])][: 4 * FIRST]
        for lo in range(0, len(columns), max(1, CELLS // len(rows))):
            part = columns[lo : lo + max(1, CELLS // len(rows))]
            self._cells(np.repeat(rows, len(part)), np.tile(part, len(rows)))
        if names[first[0]] < POOR:
            self._likely(rows)
        near = of.most[rows] >= (1 - 1 / LEVELS) * of.most[rows].max(1)[:, None]
        best, done = names.max(), np.zeros(near.shape, bool)
        for now in (near, ~near):
            floor = self.floor[rows, None] * self.length[rows]
            direct = now & (left + self.square * of.plain[rows] >= floor)
            done |= direct
            needed = floor - self.square * of.most[rows]
            needed = np.where(now, np.where(direct, needed, np.maximum(needed, least_near)), np.inf)
            least = needed.min(0)
            if least.min() > best:
                continue
            like = np.flatnonzero(names >= least.min())
            columns = o.by_name[spread(o.name_first[like], o.name_size[like])] if 4 * o.name_size[like].sum() < len(o.kind) else np.arange(len(o.kind))
            n, kind = names[o.name[columns]], o.kind[columns]
            on = np.flatnonzero(n >= least[kind])
            columns, n, kind = columns[on], n[on], kind[on]
            if len(rows) == 1:
                for lo in range(0, len(columns), CELLS):
                    part = columns[lo : lo + CELLS]
                    self._cells(np.full(len(part), rows[0]), part)
                continue
            key = 4 * kind + (1.5 - n)  # the patterns' others, those with the best names first
            order = np.argsort(key)
            columns, key = columns[order], key[order]
            begin = np.searchsorted(key, 4 * np.arange(len(least)))
            i, k = np.nonzero(needed <= best)
            end = np.searchsorted(key, 4 * k + (1.5 - np.clip(needed[i, k], -1, 2)) + SLACK, "right")
            self._lists(rows[i], columns, begin[k], np.maximum(end - begin[k], 0))
        return left, done

    def _likely(self, rows: np.ndarray) -> None:
        """The others that have the best rare word of a length, of the patterns that reach most."""
        of, o = self.addresses, self.others
        few = min(4, of.most.shape[1])
        kinds = np.argpartition(-of.most[rows], few - 1, axis=1)[:, :few]
        worth = np.abs(of.both[rows]) if len(rows) < self.n else np.abs(of.both)
        for a, z in of.classes:
            if z > a:
                word = a + worth[:, a:z].argmax(1)
                for j in range(few):
                    begin, size = o.having(word, kinds[:, j])
                    self._lists(rows, o.by_word, begin, np.minimum(size, FIRST // 8 + 1))

    def _by_words(self, most: np.ndarray, done: np.ndarray) -> None:
        """Others with names like ``most`` at most: all of a pattern whose frequent words are enough, else by the rare words."""
        of, o = self.addresses, self.others
        near = of.most >= (1 - 1 / LEVELS) * of.most.max(1)[:, None]
        size = np.diff(o.first)
        for now in (near, ~near):
            needed = (self.floor[:, None] * self.length - most[:, None]) / self.square - SLACK
            now = now & ~done & (of.most >= needed)
            direct = now & (of.plain >= needed)
            i, k = np.nonzero(direct)
            self._lists(i, np.arange(len(o.kind)), o.first[k], size[k])
            row, kind = np.nonzero(now & ~direct)
            # An address lacks so much; of what its words can add, each length has its share, and one word has its part of the lack.
            lack = needed[row, kind] - of.plain[row, kind]
            tops = (of.most_gram[kind, None] * of.top_gram[row] + of.most_word[kind, None] * of.top_word[row]) * of.slots[kind]
            total = tops.sum(1)
            main = tops.argmax(1)
            each = np.arange(len(row))
            alone = (lack - total + tops[each, main]) / np.maximum(of.slots[kind, main], 1)
            edge = np.where(of.slots[kind] > 0, (lack / np.maximum(total, SLACK))[:, None] * tops / np.maximum(of.slots[kind], 1), np.inf)
            only = alone > ALONE * tops[each, main] / np.maximum(of.slots[kind, main], 1)  # words of the main length are enough to tell
            edge[only] = np.inf
            edge[only, main[only]] = alone[only]
            edge = edge - SLACK
            for c, (a, z) in enumerate(of.classes):
                on = np.flatnonzero(edge[:, c] < np.inf)
                if z > a and len(on):
                    self._rare(row[on], kind[on], edge[on, c], a, z)

    def _rare(self, row: np.ndarray, kind: np.ndarray, edge: np.ndarray, a: int, z: int) -> None:
        """Others of a row and a pattern with a word from a to z that is worth so much at least; sorted by row."""
        of, o = self.addresses, self.others
        rows, first, many = np.unique(row, return_index=True, return_counts=True)
        least = np.minimum.reduceat(edge, first)
        part = of.both[rows, a:z]
        i, word = np.nonzero(part.real * of.most_gram[kind].max() + part.imag * of.most_word[kind].max() >= least[:, None])
        worth = part[i, word]
        total = np.cumsum(many[i])
        for lo in range(0, int(total[-1]) if len(total) else 0, CELLS):
            b, e = np.searchsorted(total, (lo, lo + CELLS), "right")
            n = many[i[b:e]]
            at, w = spread(first[i[b:e]], n), np.repeat(worth[b:e], n)
            k = kind[at]
            on = np.flatnonzero(w.real * of.most_gram[k] + w.imag * of.most_word[k] >= edge[at])
            begin, size = o.having(np.repeat(a + word[b:e], n)[on], k[on])
            self._lists(row[at[on]], o.by_word, begin, size)

    def _lists(self, row: np.ndarray, columns: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """The others in a part of the columns for each row."""
        on = size > 0
        row, first, size = row[on], first[on], size[on]
        total = np.cumsum(size)
        for lo in range(0, int(total[-1]) if len(total) else 0, CELLS):
            a, z = np.searchsorted(total, (lo, lo + CELLS), "right")
            self._cells(np.repeat(row[a:z], size[a:z]), columns[spread(first[a:z], size[a:z])])

    def _cells(self, i: np.ndarray, j: np.ndarray) -> None:
        """Brings pairs (row, other) into ``found``: score at nine decimals, then the place of the id."""
        of, o, k = self.addresses, self.others, self.found.shape[1]
        cos = of.cells(i, o.addr[j])
        length = self.length.ravel().take(i * self.length.shape[1] + o.kind[j])
        needed = self.floor[i] * length
        on = np.flatnonzero(self.top[i] + self.square * cos >= needed)
        i, j, cos, length, needed = i[on], j[on], cos[on], length[on], needed[on]
        name = self.table.ravel().take(self.name[i] * self.table.shape[1] + o.name[j])
        score = name + self.square * cos
        on = np.flatnonzero((score >= needed) & ((name > 0) | (cos > 0)))
        i = i[on]
        key = np.rint(score[on] / length[on] * NINE).astype(np.int64) << SHIFT | ((1 << SHIFT) - 1 - o.place[j[on]])
        order = np.lexsort((-key, i))
        i, key = i[order], key[order]
        once = np.append(True, (i[1:] != i[:-1]) | (key[1:] != key[:-1]))[: len(i)]  # a pair that two of its words name comes twice
        i, key = i[once], key[once]
        at = np.arange(len(i)) - np.searchsorted(i, i)
        on = at < k
        i, key, at = i[on], key[on], at[on]
        if len(i):
            rows, to = np.unique(i, return_inverse=True)
            new = np.full((len(rows), int(at.max()) + 1), -1, np.int64)
            new[to, at] = key
            new = np.sort(np.concatenate([self.found[rows], new], axis=1), axis=1)
            new[:, :-1][new[:, :-1] == new[:, 1:]] = -1
            self.found[rows] = np.sort(new, axis=1)[:, new.shape[1] - k :]
            self.floor[rows] = (self.found[rows].min(1) >> SHIFT) / NINE - SLACK


class _Others:
    """The other side's records by pattern, with lists of those of a name, and of a rare word and pattern."""

    def __init__(self, right: _Side, addresses: _Addresses):
        self.place = np.argsort(addresses.kind[right.addr], kind="stable")
        self.name, self.addr = right.name[self.place], right.addr[self.place]
        self.kind = addresses.kind[self.addr]
        self.first = np.searchsorted(self.kind, np.arange(len(addresses.often) + 1))
        self.by_name = np.argsort(self.name, kind="stable")
        self.name_size = np.bincount(self.name, minlength=len(right.names))
        self.name_first = np.cumsum(self.name_size) - self.name_size
        slot, column = np.nonzero(addresses.rare[:, self.addr] < addresses.n_words)
        self.kinds = len(addresses.often)
        key = addresses.rare[slot, self.addr[column]] * self.kinds + self.kind[column]
        order = np.argsort(key, kind="stable")
        self.by_word = column[order]
        self.keys, self.key_size = np.unique(key, return_counts=True)
        self.key_first = np.cumsum(self.key_size) - self.key_size
        self.at = None
        if addresses.n_words * self.kinds <= TABLE // 16:
            self.at = np.full(addresses.n_words * self.kinds, -1, np.int32)
            self.at[self.keys] = np.arange(len(self.keys))

    def having(self, word: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the others with the word and the pattern begin in ``by_word``, and their number."""
        key = word * self.kinds + kind
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if self.at is None else self.at[key]
        return self.key_first[at], np.where(self.keys[at] == key, self.key_size[at], 0)
