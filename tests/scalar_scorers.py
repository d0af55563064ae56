"""Edit measures of two texts, one pair at a time: what the vectorised ones are held against."""


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def sorted_ratio_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio_of(a: str, b: str) -> float:
    """Best ratio among common words alone and with either side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    gap = 1 if both else 0
    n1, n2 = len(both) + gap + len(left), len(both) + gap + len(right)
    best = 1 - (len(left) + len(right) - 2 * subsequence(left, right)) / (n1 + n2)
    if both:
        best = max(best, 2 * len(both) / (len(both) + n1), 2 * len(both) / (len(both) + n2))
    return best


def partial_ratio_of(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer one, no longer than itself."""
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    parts = {long[i : i + m] for i in range(n - m + 1)} | {long[:k] for k in range(1, m)} | {long[n - k :] for k in range(1, m)}
    best = max(ratio_of(short, p) for p in parts)
    if m == n and best < 1:
        best = max(best, *(ratio_of(long, p) for p in {short[:k] for k in range(1, m)} | {short[n - k :] for k in range(1, m)} | {short}))
    return best


def jaro_winkler_of(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u)))
    jaro = (m / len(a) + m / len(b) + (m - swapped // 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro
