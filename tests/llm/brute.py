"""Plain versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(text: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text)


def words(text: str | None, low: bool = True) -> list[bytes]:
    data = (text or "").encode()
    return WORD.findall(lower(data) if low else data)


def shingles(text: str | None, size: int) -> set[tuple]:
    found = words(text)
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} or {tuple(found)}


def repeats(texts: list[str | None], window: int = 35) -> list[list[bool]]:
    """For each text whether a window that also starts elsewhere covers each word."""
    each = [words(t, low=False) for t in texts]
    seen = Counter(tuple(x[i : i + window]) for x in each for i in range(len(x) - window + 1))
    out = []
    for x in each:
        covered = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        out.append(covered)
    return out


def groups(texts: list[str | None], size: int, percent: int) -> list[int]:
    """The first index of each text's component."""
    sets, parent = [shingles(t, size) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))]


class Contexts:
    """Prediction by partial matching with a dictionary of contexts."""

    def __init__(self, texts: list[bytes], order: int = 5):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.steps(text):
                for k in range(order + 1):
                    self.counts[context[order - k :]][symbol] += 1

    def steps(self, text: bytes):
        data = b"\xfe" * self.order + text + b"\xff"
        for i in range(self.order, len(data)):
            yield data[i - self.order : i], data[i]

    def score(self, text: bytes) -> float:
        total = 0.0
        for context, symbol in self.steps(text):
            out: set[int] = set()
            for k in range(self.order, -1, -1):
                seen = {s: n for s, n in self.counts.get(context[self.order - k :], {}).items() if s not in out}
                if not seen:
                    continue
                whole = 2 * sum(seen.values())
                if symbol in seen:
                    total += math.log10((2 * seen[symbol] - 1) / whole)
                    break
                total += math.log10(len(seen) / whole)
                out |= set(seen)
            else:
                total -= math.log10(max(1, 255 - len(out)))
        return total


def letters(text: str) -> list[bytes]:
    """Runs of ASCII letters and bytes beyond ASCII, in lower case."""
    return re.findall(rb"[a-z\x80-\xff]+", lower(text.encode()))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """The best segment, then those to its left and right, again and again."""
    best, low, at, total, out = (0.0, 0, 0), 0.0, 0, 0.0, None
    for i, x in enumerate(scores):
        total += x
        if total - low > best[0] + 1e-12:
            best = (total - low, at, i + 1)
        if total < low:
            low, at = total, i + 1
    if best[0] <= 0:
        return []
    _, a, b = best
    return segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in segments(scores[b:])]


def shifts(places: list[tuple[str, str]], p: list[float]) -> dict[tuple[str, str], float]:
    """What (site, path) adds to the log-odds: means shrunk to the site's, those to the global one."""
    n, mean = len(p), sum(p) / len(p)
    within = sum(x * x for x in p) / n - mean * mean
    sites, paths = defaultdict(list), defaultdict(list)
    for (site, path), x in zip(places, p, strict=True):
        sites[site].append(x)
        paths[site, path].append(x)
    average = lambda x: sum(x) / len(x)

    def strength(between: float) -> float:
        return 1e6 if between <= 0 else min(1e6, max(1.0, mean * (1 - mean) / between - 1))

    outer = strength((sum(len(x) * (average(x) - mean) ** 2 for x in sites.values()) - within * len(sites)) / n)
    inner = strength((sum(len(x) * (average(x) - average(sites[k[0]])) ** 2 for k, x in paths.items()) - within * len(paths)) / n)
    out = {}
    for (site, path), x in paths.items():
        above = (sum(sites[site]) + outer * mean) / (len(sites[site]) + outer)
        value = (sum(x) + inner * above) / (len(x) + inner)
        out[site, path] = math.log(value / (1 - value)) - math.log(mean / (1 - mean))
    return out


def cosine_hash(image) -> str:
    """64 low frequencies of the image averaged to 32 x 32, each by the cosine sum over all pixels."""
    height, width = image.shape

    def spans(n: int) -> list[range]:
        edges = [i * n // 32 for i in range(32)] + [n]
        return [range(edges[i], max(edges[i] + 1, edges[i + 1])) for i in range(32)]

    small = [[sum(int(image[y, x]) for y in ys for x in xs) / (len(ys) * len(xs)) for xs in spans(width)] for ys in spans(height)]
    wave = [[math.cos(math.pi / 32 * (x + 0.5) * u) for x in range(32)] for u in range(8)]
    half = [[sum(wave[u][y] * small[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    low = [round(sum(half[u][x] * wave[v][x] for x in range(32)), 6) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "".join(str(int(x > rest[31])) for x in low)
    return f"{int(bits, 2):016x}"


def best_fit_bins(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)
