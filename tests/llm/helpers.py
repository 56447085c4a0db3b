"""Small tables with the awkward rows that every operator must stand, and brute force."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}" for a in "ba ce di fo gu ha ke li mo nu".split() for b in "n r s t l".split()]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    """Random words in lines of some twelve words."""
    rng = random.Random(seed)
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return ".\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def edited(text, seed, every):
    """The text with each so many words replaced."""
    rng = random.Random(seed)
    words = text.split(" ")
    for i in range(rng.randrange(every), len(words), every):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    """By doc_id: prose, copies, near copies, shared passages, null, empty, short, very long."""
    base, passage = prose(1, 300), prose(2, 60)
    found = {0: base, 1: base, 2: edited(base, 3, 60), 3: edited(base, 4, 8), 4: None, 5: "", 6: " \n\t ",
             7: "one two three", 8: "ONE Two three", 9: passage, 10: f"{prose(5, 40)} {passage} {prose(6, 40)}",
             11: f"{prose(7, 30)} {passage} tail", 12: "same line here again\n" * 30, 13: "###%%% " * 40,
             14: "aaaa " * 300, 15: prose(8, 6000), 16: prose(8, 5990) + " other end", 17: "z" * 5000,
             18: "é ü　ñ　x  y\r\n" * 20, 19: "<|endoftext|> it's  we'll   12 3.4 "}
    found |= {100 + k: edited(base, k, 70) for k in range(12)}
    found |= {200 + k: f"{prose(k, 50)} {passage}" for k in range(8)}
    return found


def rows(extra=()):
    """The texts as rows, with nulls in every column, a repeated row and a null id."""
    found = [(k, t, "en" if k % 3 else None, "web" if k % 4 else None, None if k % 5 == 0 else len(t or ""))
             for k, t in texts().items()]
    return [*found, found[9], (None, prose(77, 80), None, None, None), *extra]


def documents(spark, data=None):
    """With a column whose name an operator might use itself."""
    made = spark.createDataFrame(rows() if data is None else data, DOCS)
    return made.selectExpr("*", "'kept' AS key", "1 AS start", "2 AS `a.b`", "3 AS hash")


def empty(spark):
    return documents(spark, [])
