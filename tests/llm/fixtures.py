"""Small documents that hold the awkward cases, and brute-force answers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, "
          "size string, kept string, score string, `a.b` int")


def words(text):
    return WORD.findall(text or "")


def make_texts(seed=5):
    """Texts with copies, near copies, shared passages, odd characters and nothing at all."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeÀßöñ") for _ in range(rng.randint(1, 9)))
             for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(stock) + rng.choice(["", "", "", ",", ".", "!\n"])
                        for _ in range(n))

    passage = prose(90)
    base = [prose(rng.randint(1, 260)) for _ in range(40)]
    texts = base + [base[3], base[3], base[5], None, None, "", " \n\t ", "\x0b", "one", "two words"]
    for k in range(12):  # near copies of one text
        w = base[7].split(" ")
        w[rng.randrange(len(w))] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + "  " + prose(20) for _ in range(6)]
    texts += [passage, passage + " " + passage, "ab" * 700, "a" * 900, "a" * 401, "a" * 399]
    texts += ["<|endoftext|> x<|endoftext|>  y <|startoftext|>", "ﬁne İSTANBUL Σς éé \x1c\x1d x",
              "日本語のテキスト 混ざる words 12,5 %&*", "#### $$$ %%% <b>\nline\nline\nline\n"]
    texts.append(prose(30_000))
    return texts


def make_rows(seed=5):
    rng = random.Random(seed + 1)
    rows = []
    for i, text in enumerate(make_texts(seed)):
        source = rng.choice(["src0", "src0", "src0", "b", "ü", None])
        rows.append((i * 7 % 1000, text, rng.choice(["en", "de", None]), source,
                     len(text or ""), "x", "y", "z", "w", 1))
    rows += [rows[2], rows[2], rows[40], rows[43]]          # repeated rows
    rows += [(rows[4][0], "another text of the same id", *rows[4][2:])]
    rows += [(None, "a text without id " + "w " * 60, "en", "b", 3, "x", "y", "z", "w", 1),
             (None, None, None, None, None, None, None, None, None, None)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(make_rows() if rows is None else rows, SCHEMA).repartition(3)


def removed(items, width):
    """Per list: which items lie in a stretch of `width` that starts in two places or more."""
    places = {}
    for n, row in enumerate(items):
        for i in range(len(row) - width + 1):
            places.setdefault(row[i:i + width], []).append((n, i))
    gone = [[False] * len(row) for row in items]
    for where in places.values():
        if len(where) > 1:
            for n, i in where:
                gone[n][i:i + width] = [True] * width
    return gone


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(texts):
    """Root of each text's group of linked shingle sets; None without words."""
    sets = [shingles(t) for t in texts]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if 100 * len(a & b) >= 75 * len(a | b) and root(a) is not root(b):
                parent[root(a)] = root(b)
    return [root(s) if s else None for s in sets]
