"""Small tables with the hard cases, and plain re-implementations to compare with."""

import collections
import re


def documents(spark, path, rows=None):
    """Nulls, empty and very long texts, repeats, and columns whose names the operators use themselves. On disk, since the operators read twice."""
    text = "The quick brown fox jumps over the lazy dog near the old river bank today"
    rows = rows if rows is not None else [
        (1, text, "en", "s1", 1), (2, text, "en", "s1", 1), (3, text.replace("lazy", "idle") + " and tomorrow and the day after that one", "en", None, 1),
        (4, None, None, "s2", None), (5, "", "en", "s2", 0), (6, "a b", "en", "s2", 3), (7, "a b", "en", "s2", 3), (8, "x" * 90_000 + " end", "en", "s3", 1),
        (None, "row without an id", "en", "s3", 1), (9, "\n\n  \n", "en", "s3", 5), (9, "\n\n  \n", "en", "s3", 5), (10, "one line\nOne line\none line \nanother thing entirely", "de", "s1", 9),
        (11, " ".join(f"word{i}" for i in range(9000)) + "  two  spaces\tand tabs \U0001f600", "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("key", "root", "row", "id", "size", "slice", "label", "mx_id", "_text", "_row"):
        df = df.selectExpr("*", f"'clash' as `{extra}`")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def brute_lines(rows, k=5, least=0.8):
    """(id, text) in order -> kept text by row number."""
    strip = " \t\r\x0b\x0c"
    sets, order = {}, []
    for _, t in rows:
        for line in (t or "").split("\n"):
            b = line.strip(strip)
            if b and b not in sets:
                sets[b] = {b[j : j + k] for j in range(max(1, len(b) - k + 1))}
                order.append(b)
    up = {b: b for b in order}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            n = len(sets[a] & sets[b])
            if n >= least * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    seen, out = set(), {}
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r)):
        t = rows[r][1]
        if t is None:
            out[r] = None
            continue
        keep = []
        for line in t.split("\n"):
            if b := line.strip(strip):
                if find(b) in seen:
                    continue
                seen.add(find(b))
            keep.append(line)
        out[r] = "\n".join(keep)
    return out


def brute_join(rows, words=5, least=0.8):
    """(id, text) -> by row number: links, and the component as a set of row numbers."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    near = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= least * len(a | b):
                near[i].add(j)
                near[j].add(i)
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            stack, got = [i], set()
            while stack:
                x = stack.pop()
                if x not in got:
                    got.add(x)
                    stack += near[x]
            comp |= {x: frozenset(got) for x in got}
    return {i: len(near[i]) for i in range(len(rows))}, comp
