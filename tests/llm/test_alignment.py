"""Aligned tokens against a plain walk over the bytes with the two libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from helpers import documents, empty, prose, rows
from tokenizers import Tokenizer

from palestra.llm import alignment, queries

FIRST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
# the byte that each letter of the byte-level vocabulary stands for
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def tokens(text):
    a = FIRST.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    b = [(i, bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode())
         for i in SECOND.encode(text)]
    whole = b" " + text.encode()
    return (a, b) if text and b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def groups_of(text):
    a, b = tokens(text or "")
    found, i, j = [], 0, 0
    while i < len(a):
        one, two = [a[i]], [b[j]]
        while sum(len(x) for _, x in one) != sum(len(x) for _, x in two):
            if sum(len(x) for _, x in one) < sum(len(x) for _, x in two):
                i += 1
                one.append(a[i])
            else:
                j += 1
                two.append(b[j])
        found.append(([x for x, _ in one], [x for x, _ in two]))
        i, j = i + 1, j + 1
    return found


def expected(data):
    by_row = [groups_of(t) for _, t, *_ in data]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in by_row]
    counts = Counter(p for pairs in linked for p in pairs)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for (key, *_), groups, pairs in zip(data, by_row, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()),
                    sum(n for p, n in pairs.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in pairs.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def awkward():
    found = ["<|endoftext|><s></s><unk>", "a▁b", "<0x41>", "  two  spaces ", "日本語のテキスト 😀👍🏽 ok", "\u0000\u0001x", "tab\tand\r\nlines\n\n\n",
             "ﬁ ½ Å", "ééééé", "x", " ", "don't we'll 12345 0.5%", "مرحبا بالعالم", prose(3, 900), "日" * 3000]
    return [(3000 + k, t, None, None, None) for k, t in enumerate(found)]


@pytest.mark.parametrize("heavy", [1 << 20, 300, 1])
def test_digests_equal_brute_force(spark, heavy, monkeypatch):
    data = rows(awkward())
    found = alignment.scored(documents(spark, data), queries.vocabulary(), queries.pieces_model(), heavy)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(data)


def test_documents_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_PER_ROW", 10)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 16)
    data = rows(awkward())
    found = alignment.scored(documents(spark, data), queries.vocabulary(), queries.pieces_model())
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(data)


def test_empty_table(spark):
    assert alignment.scored(empty(spark), queries.vocabulary(), queries.pieces_model()).count() == 0


def test_groups_hold_the_ids(spark):
    data = rows(awkward())
    found = defaultdict(list)
    for r in alignment.groups(documents(spark, data), queries.vocabulary(), queries.pieces_model()).orderBy("group").collect():
        found[r["doc_id"]].append((r["a"], r["b"]))
    once = {k: groups_of(t) for k, t, *_ in data if k != 9}
    assert {k: found[k] for k in once} == once
    assert sorted(map(repr, found[9])) == sorted(map(repr, 2 * groups_of(next(t for k, t, *_ in data if k == 9))))
