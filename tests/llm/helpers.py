"""Small tables with every awkward case, and plain Python versions of what the operators return."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Row  # noqa: F401

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, digit string, grp long, node long, level int, "
    "token long, size string, target string, taken string, comp long, u string, part int, _key string, held_out string, score string"
)
ODD = [None, "", "  \n\t ", "A b C", "a B c", "É é", "▁x y", "one two three four five six seven", "word " * 30000, "x" * 150000 + " end", "日本語 テキスト", "</s>[INST]"]


def edge(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[7], (None, "A b C", "en", "s", 1), (3, "another text under a used id here", "en", None, 2), (40, "one two three four five six eight", "de", "t", 3)]
    return spark.createDataFrame([(*r, *[None] * 15) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


def union_find(n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    return find, join


def shingles(t, k=4):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """(id, text) -> per row (id, set size, smallest id of its component)."""
    sets = [shingles(t) for _, t in rows]
    find, join = union_find(len(rows))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in where[x])
        for j, n in met.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                join(i, j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def base_quality(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def mix(rows, uniform, share=1.5, most=2, cycle=(3, 1, 2)):
    """rows of (id, source, size, quality weight) -> (targets by source, [(id, size, source, taken)])."""
    total = defaultdict(int)
    for _, s, n, _ in rows:
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= over
    out = []
    for s in order:
        epochs = min(most, math.floor(target[s] / total[s])) if total[s] else 0
        budget = math.floor(target[s] + 1e-6) - epochs * total[s]
        mine = sorted(((-math.log(uniform(d)) / w, d, n) for d, x, n, w in rows if x == s), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        for _, d, n in mine:
            part = 0 if epochs >= most else min(n, max(budget, 0))
            budget -= n
            out.append((d, n, s, epochs * n + part))
    return target, out
