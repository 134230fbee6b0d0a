"""Small texts with the odd cases every operator has to stand, and plain versions
of what the operators compute."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with the names of results, to clash with them.
EXTRA = ", n_words int, kept string, spans string, component_id string, row string"


def words(rnd, n, vocabulary="a b c d é ff g hh the of in".split()):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def sample_texts(seed=5, n=60):
    """Pieces of a few bases between random words, some with a changed letter; then
    nulls, empty and short texts, repeats of one unit, and a very long text."""
    rnd = random.Random(seed)
    base = [words(rnd, 220) for _ in range(5)]
    texts = []
    for _ in range(n):
        b = rnd.choice(base).split(" ")
        low = rnd.randrange(150)
        piece = b[low : low + rnd.randrange(5, 200)]
        if rnd.random() < 0.4:
            piece[rnd.randrange(len(piece))] = "Zz"
        head, tail = words(rnd, rnd.randrange(60)), words(rnd, rnd.randrange(60))
        texts.append(rnd.choice([" ", "\n", "\t"]).join([head, *piece, tail]))
    texts += ["a" * 500, "ab" * 300, "", None, " \n\t ", "one", "x y z", "q" * 200, "q" * 199]
    texts += [words(rnd, 40) * 4, base[0], base[0], base[0].upper(), words(rnd, 30_000)]
    return texts


def documents(spark, texts, extra=False):
    """Texts as documents; the last row repeats the one before, one id is null."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows[3] = (None, *rows[3][1:])
    rows.append(rows[-1])
    if extra:
        rows = [(*r, 1, "k", "s", "c", "r") for r in rows]
    return spark.createDataFrame(rows, DOC_SCHEMA + (EXTRA if extra else ""))


def plain_rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    w = WORD.findall(ascii_lower(text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def plain_components(rows, percent=85):
    """Least id reached, by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in holders.get(g, ()))
        for j, common in met.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
