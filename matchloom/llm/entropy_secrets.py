"""Secret scan with DataFrame functions only.

Named patterns give the base spans.  The method proper looks at candidate strings
(long runs of key characters) through a sliding window: the counts of the window's
characters, and with them the sum of n log2 n, are carried along and changed by the
character that enters and the one that leaves, so the Shannon entropy of every
window costs the same few steps.  Counts are five bits each, twelve in a number.  The
window's character class sets the entropy that makes it a secret.  Candidates that
are allowed as a whole are left out, as are those inside a base span; where a
candidate holds an allowed string, the windows that touch it are left out.

A long text is cut into pieces where no pattern can match across, a long candidate
into overlapping blocks of windows, and places are summed in two levels, so the time
grows with the length of the text.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
#: Character classes in the order they are tried: least entropy in bits of a window.
LEAST_ENTROPY = {"hex": 3.0, "one_case": 3.5, "mixed": 3.8}

# Patterns of the base kinds, in order, and the least length of a group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Alphabet of candidates; digits, a-f, g-z, A-F, G-Z and signs follow each other.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Strings that look random and are not secret; whole candidates, and parts of them.
ALLOWED_WHOLE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^sha(1|256|384|512)-"
ALLOWED_PART = r"(?i:example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefghij|qwerty)|(.)\1{7,}"
#: Least code points of a piece.  It ends at a character that no pattern has, or at blanks that no sign of assignment is next to.
PIECE = 4096
_PIECES = rf"""(?s).{{{PIECE}}}.*?(?:[^A-Za-z0-9+/_.=\-"'\x20:]|(?<![:=\x20])\x20(?![:=\x20])|\z)|.+"""
BLOCK = 256  # numbers summed at a time
STEPS = 4096  # windows counted at a time
_PER_WORD = 12
_WORDS = -(-len(ALPHABET) // _PER_WORD)


def _starts(lengths: str) -> str:
    """Sum of all numbers before each one of an array."""
    none = "cast(array() as array<int>)"
    blocks = f"transform(sequence(0, greatest(size({lengths}) - 1, 0) div {BLOCK}), b -> aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), named_struct('p', 0, 'o', {none}), (a, x) -> named_struct('p', a.p + x, 'o', concat(a.o, array(a.p)))))"
    return f"transform(array({blocks}), l -> flatten(zip_with(l, aggregate(l, named_struct('p', 0, 'o', {none}), (a, x) -> named_struct('p', a.p + x.p, 'o', concat(a.o, array(a.p))), a -> a.o), (x, t) -> transform(x.o, y -> y + t))))[0]"


def _spans(matches: str, gaps: str) -> str:
    """Array of (s, e, v) from a pattern's matches and the lengths of the text between them."""
    empty = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    return f"""if(size({matches}) = 0, {empty}, transform(
        array(zip_with({matches}, slice({gaps}, 1, size({matches})), (v, g) -> named_struct('v', v, 'g', g, 'n', g + length(v)))),
        z -> transform(array(transform(z, x -> x.n)), n -> zip_with(z, {_starts('n')}, (x, p) -> named_struct('s', p + x.g, 'e', p + x.n, 'v', x.v)))[0])[0])"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _windows(codes: str, window: int) -> str:
    """First and last window of a string of alphabet places that its class makes secret (0: none)."""
    part = lambda n: f"if({n} > 1, {n} * log2({n}), 0D)"
    come, go = f"{codes}[i]", f"if(i < {window}, 0, {codes}[greatest(i - {window}, 0)])"
    inside = lambda name, test: f"a.{name} + if({test('x.come')}, 1, 0) - if(x.go > 0 and {test('x.go')}, 1, 0) as {name}"
    classes = {
        "digits": lambda c: f"{c} <= 10", "lower": lambda c: f"{c} between 11 and 36", "upper": lambda c: f"{c} between 37 and 62",
        "low_hex": lambda c: f"{c} <= 16", "up_hex": lambda c: f"({c} <= 10 or {c} between 37 and 42)",
    }
    entropy = f"(log2({window}D) - b.s / {window}D)"
    secret = f"""(b.i >= {window} and b.digits > 0 and b.digits < {window} and case
        when b.low_hex = {window} or b.up_hex = {window} then {entropy} >= {LEAST_ENTROPY['hex']}D
        when b.digits + b.lower = {window} or b.digits + b.upper = {window} then {entropy} >= {LEAST_ENTROPY['one_case']}D
        when b.lower > 0 and b.upper > 0 then {entropy} >= {LEAST_ENTROPY['mixed']}D
        else false end)"""
    word, shift = (lambda c: f"({c} - 1) div {_PER_WORD}"), (lambda c: f"cast(5 * (({c} - 1) % {_PER_WORD}) as int)")
    count = lambda c: f"(shiftright(element_at(a.n, cast({word(c)} + 1 as int)), {shift(c)}) & 31L)"
    enter, leave = count("x.come"), count("greatest(x.go, 1)")
    change = f"if(x.come = x.go, 0D, {part(f'({enter} + 1)')} - {part(enter)} + if(x.go = 0, 0D, {part(f'({leave} - 1)')} - {part(leave)}))"
    step = f"""
        transform(array(struct(
            a.i + 1 as i, a.s + {change} as s, {', '.join(inside(k, v) for k, v in classes.items())},
            if(x.come = x.go, a.n, transform(a.n, (c, j) -> c + if(j = {word('x.come')}, shiftleft(1L, {shift('x.come')}), 0L) - if(x.go > 0 and j = {word('x.go')}, shiftleft(1L, {shift('x.go')}), 0L))) as n, a.first as first, a.last as last)),
            b -> struct(b.i as i, b.s as s, {', '.join(f'b.{k} as {k}' for k in classes)}, b.n as n,
                if({secret}, if(b.first = 0, b.i, b.first), b.first) as first, if({secret}, b.i, b.last) as last))[0]"""
    start = f"struct(0 as i, 0D as s, {', '.join(f'0 as {k}' for k in classes)}, array_repeat(0L, {_WORDS}) as n, 0 as first, 0 as last)"
    return f"aggregate(transform(sequence(0, size({codes}) - 1), i -> struct({come} as come, {go} as go)), {start}, (a, x) -> {step}, a -> struct(a.first as first, a.last as last))"


def _hits(codes: str, window: int) -> str:
    """The same for any number of windows, block by block; null if there is none."""
    blocks = f"transform(sequence(0, (size({codes}) - {window}) div {STEPS}), k -> transform(array(slice({codes}, k * {STEPS} + 1, {STEPS + window - 1})), d -> transform(array({_windows('d', window)}), w -> named_struct('first', k * {STEPS} + w.first, 'last', k * {STEPS} + w.last, 'some', w.first > 0))[0])[0])"
    return f"transform(array(filter({blocks}, w -> w.some)), h -> if(size(h) = 0, null, named_struct('first', h[0].first, 'last', element_at(h, -1).last)))[0]"


def _named(pattern: str, group: int, least: int, number: int, kind: str) -> str:
    """A base kind's spans whose group is long enough."""
    text = f"regexp_extract(x.v, {_quoted(pattern)}, {group})" if group else "x.v"
    return f"transform(filter(q.s_{kind}, x -> length({text}) >= {least}), x -> named_struct('start', x.s, 'kind_no', {number}, 'end', x.e, 'kind', '{kind}'))"


def _runs(candidate: str, window: int) -> str:
    """Parts (s, v) of a candidate between its allowed strings."""
    between = f"transform(array(split({candidate}.v, {_quoted(ALLOWED_PART)}, -1)), g -> {_parts(candidate)})[0]"
    return f"filter(if({candidate}.v rlike {_quoted(ALLOWED_PART)}, {between}, array(named_struct('s', {candidate}.s, 'v', {candidate}.v))), r -> length(r.v) >= {window})"


def _parts(candidate: str) -> str:
    lengths = f"zip_with(g, regexp_extract_all({candidate}.v, {_quoted(ALLOWED_PART)}, 0), (u, m) -> length(u) + coalesce(length(m), 0))"
    return f"transform(array({lengths}), n -> zip_with(g, {_starts('n')}, (u, p) -> named_struct('s', {candidate}.s + p, 'v', u)))[0]"


def _count(number: int, kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind_no"] == number)).cast("long").alias(f"n_{kind}")


def scan_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``found``: an array of (start, kind_no, end, kind), ascending; kind ``entropy`` is the method's.

    Null or empty text has none.  Overlapping spans of different kinds all stay.
    Further columns are kept; one named ``found`` is replaced, names that start
    with ``__ml_`` must be free.
    """
    docs = docs.drop("found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = {**{name: pattern for name, pattern, _, _ in KINDS}, "candidate": CANDIDATE}
    found = docs.withColumn("__ml_t", text)
    found = found.withColumn("__ml_p", F.when(F.length("__ml_t") < 2 * PIECE, F.array("__ml_t")).otherwise(F.regexp_extract_all("__ml_t", F.lit(_PIECES), F.lit(0))))
    found = found.withColumns({f"__ml_m_{k}": F.expr(f"transform(__ml_p, p -> regexp_extract_all(p, {_quoted(v)}, 0))") for k, v in patterns.items()})
    found = found.withColumns({f"__ml_g_{k}": F.expr(f"zip_with(__ml_p, __ml_m_{k}, (p, m) -> if(size(m) = 0, cast(array() as array<int>), transform(split(p, {_quoted(v)}, -1), u -> length(u))))") for k, v in patterns.items()})
    found = found.withColumns({f"__ml_s_{k}": F.expr(f"zip_with(__ml_m_{k}, __ml_g_{k}, (m, g) -> {_spans('m', 'g')})") for k in patterns})
    names = [*patterns]
    found = found.withColumn("__ml_q", F.arrays_zip(*[F.col(f"__ml_s_{k}").alias(f"s_{k}") for k in names]))
    base = ", ".join(_named(pattern, group, least, number, kind) for number, (kind, pattern, group, least) in enumerate(KINDS))
    found = found.withColumn("__ml_b", F.expr(f"transform(__ml_q, q -> named_struct('b', concat({base}), 'c', q.s_candidate))"))
    free = f"filter(q.c, x -> not x.v rlike {_quoted(ALLOWED_WHOLE)} and not exists(q.b, b -> b.start <= x.s and b.end >= x.e))"
    found = found.withColumn("__ml_r", F.expr(f"transform(__ml_b, q -> named_struct('b', q.b, 'r', flatten(transform({free}, c -> {_runs('c', window)}))))"))
    coded = f"transform(q.r, r -> named_struct('s', r.s, 'c', transform(split(r.v, ''), c -> instr('{ALPHABET}', c))))"
    found = found.withColumn("__ml_c", F.expr(f"transform(__ml_r, q -> named_struct('b', q.b, 'r', {coded}))"))
    scored = f"filter(transform(q.r, r -> named_struct('s', r.s, 'w', {_hits('r.c', window)})), r -> r.w is not null)"
    found = found.withColumn("__ml_w", F.expr(f"transform(__ml_c, q -> named_struct('b', q.b, 'r', {scored}))"))
    extra = f"transform(q.r, r -> named_struct('start', r.s + r.w.first - {window}, 'kind_no', {len(KINDS)}, 'end', r.s + r.w.last, 'kind', 'entropy'))"
    outside = f"filter({extra}, x -> not exists(q.b, b -> b.start <= x.start and b.end >= x.end))"
    moved = f"zip_with(__ml_w, {_starts('__ml_n')}, (q, p) -> transform(concat(q.b, {outside}), x -> named_struct('start', x.start + p, 'kind_no', x.kind_no, 'end', x.end + p, 'kind', x.kind)))"
    found = found.withColumn("__ml_n", F.expr("transform(__ml_p, p -> length(p))"))
    return found.withColumn("found", F.array_sort(F.flatten(F.expr(moved)))).select(*docs.columns, "found")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of their list, and the list of all spans."""
    rows = scan_secrets(docs, text_col)
    base = F.filter("found", lambda x: x["kind_no"] < len(KINDS))
    counts = [_count(number, kind) for number, (kind, *_) in enumerate(KINDS)]
    return rows.select(F.col(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
