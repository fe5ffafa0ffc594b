"""Packing, token counts, licences and personal data against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from scoreline.llm import licenses, packing, pii, wordpiece
from scoreline.llm.queries import tokenizer_path

ODD = ["", " ", "  a  b", "a ", "x <|endoftext|> y<|endoftext|>z", "a\n b", "it's 12 34 !! ??  ",
       "　a b  c d", "a\x1c b c\x1f d", "a\x85 b", "a\x00 b \x01 c", "word " * 3000, "z" * 4000]


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus + [(1000 + i, t) for i, t in enumerate(ODD)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    got = packing.pack(frame(spark, rows), tokenizer_path()).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
    assert pieces.keys() == want.keys()
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(want[i])
    pad = total = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        total += at
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    assert pad <= 0.02 * total


def test_classes_have_fixed_counts():
    p = packing.Packer(1024, packing.SLACK, 0)
    for i in range(40):
        p.add(i, np.arange(340, dtype=np.uint32))        # class 3: 3 * 340 of 1024
    full = [r for r in p.rows if r[2] == 340]
    counts = np.bincount([r[5] for r in full])
    assert set(counts[counts > 0].tolist()) == {3}
    with pytest.raises(ValueError):
        packing.pack(None, "", capacity=1000)


def test_packing_edges(spark, documents):
    got = packing.pack(documents, tokenizer_path()).collect()
    assert any(r.doc_id is None for r in got)
    assert packing.pack(documents.where("false"), tokenizer_path()).collect() == []


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer
    vocab = Tokenizer.from_file(tokenizer_path()).get_vocab(with_added_tokens=False)
    pieces = set(wordpiece.byte_level_pieces(vocab))
    longest = max(map(len, pieces))

    def greedy(word):
        s, n, i = b" " + word, 0, 0
        while i < len(s):
            j = next(j for j in range(min(len(s), i + longest), i, -1)
                     if s[i:j] in pieces and (i == 0 or s[i:i + 1] != b" "))
            i, n = j, n + 1
        return n
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in
           wordpiece.token_counts(frame(spark, rows), tokenizer_path()).collect()}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        assert got[i] == (len(w), sum(map(greedy, w)))


def test_long_unbroken_word_takes_linear_time():
    """Alone or beside others, a word has the same count."""
    pieces = [b"ab", b"abc", b"a", b"b", b"c", b"cab", b"d"]
    match = wordpiece.LongestMatch(pieces, pieces)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    ends = np.cumsum([len(w) for w in words])
    buf = np.frombuffer(b"".join(words), dtype=np.uint8)
    together = match.count(buf, ends - [len(w) for w in words], ends, None)
    alone = [match.count(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]), None)[0]
             for w in words]
    assert together.tolist() == [int(n) for n in alone]
    begun = time.perf_counter()
    assert match.count(np.full(1_000_000, ord("d"), dtype=np.uint8), np.array([0]),
                       np.array([1_000_000]), None)[0] == 1_000_000
    assert time.perf_counter() - begun < 20


def test_longest_match_on_small_vocabularies():
    rng = np.random.default_rng(3)

    def word(n):
        return bytes(rng.choice(list(b"abc"), rng.integers(1, n)).tolist())
    for _ in range(100):
        first, later = [word(5) for _ in range(5)], [word(6) for _ in range(8)]
        match = wordpiece.LongestMatch(first, later)
        words = [word(10) for _ in range(20)]
        buf = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        got = match.count(buf, ends - [len(w) for w in words], ends, None)
        for w, n in zip(words, got.tolist()):
            i = c = 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (later if i else first)), 0)
                if not j:
                    c = 1
                    break
                i, c = j, c + 1
            assert c == n


LICENCES = [
    "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0; you may not "
    "use this file except in compliance with the License.", "the GNU General Public License and "
    "the MIT License; cc by, CC-BY!", "mit licenses", "All rights reserved.", "apache\nlicense", "",
    "GNU General Public", "é cc by"]


def test_licences(spark):
    rows = list(enumerate(LICENCES)) + [(99, None), (None, "MIT License")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(
        rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = sorted((k, label) for p, label in licenses.PHRASES.items()
                        for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[0].labels == "cc-by,cc-by-nc-4.0" and got[1].labels == "apache,apache-2.0"
    assert got[4].labels == "all-rights-reserved" and got[7].labels == ""


GNU = ("This {} is free software; you can redistribute it and/or modify it under the terms of the "
       "GNU {} Public License as published by the Free Software Foundation; either version {} of "
       "the License, or (at your option) any later version.")
COMMONS = "This work is licensed under a Creative Commons Attribution{} {}.0 International License."
LOOK_ALIKES = [
    (GNU.format("program", "General", "3"), {"gpl-3.0"}),
    (GNU.format("program", "General", "2"), {"gpl-2.0"}),
    (GNU.format("library", "General", "2"), {"gpl-2.0"}),
    (GNU.format("library", "Library General", "2"), {"lgpl-2.0"}),
    (GNU.format("library", "Lesser General", "2.1"), {"lgpl-2.1"}),
    (GNU.format("program", "Lesser General", "3"), {"lgpl-3.0"}),
    (GNU.format("program", "Affero General", "3"), {"agpl-3.0"}),
    (GNU.format("program", "General", "1"), set()),
    *[(f"Licensed under CC {x.upper()} 4.0.", {f"cc-{x}-4.0"}) for x in
      ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")],
    ("Licensed under the CC BY license, version 4.0.", {"cc-by-4.0"}),
    ("Licensed under CC BY 3.0.", set()), ("Licensed under CC BY-SA 3.0.", set()),
    (COMMONS.format("", 4), {"cc-by-creative-commons"}), (COMMONS.format("", 3), set()),
    *[(COMMONS.format(y, 4), {f"cc-by-{x}-creative-commons"}) for x, y in (
        ("sa", "-ShareAlike"), ("nc", "-NonCommercial"), ("nd", "-NoDerivatives"),
        ("nc-sa", "-NonCommercial-ShareAlike"), ("nc-nd", "-NonCommercial-NoDerivatives"))],
    (COMMONS.format("-NonCommercial-NoDerivs", 4), set()),
    ("Licensed under the Apache License, Version 2.0, January 2004; you may not use this file "
     "except in compliance with the License.", {"apache-2.0"}),
    ("Licensed under the Apache License, Version 1.1; you may not use this file except in "
     "compliance with the License.", set()),
    ("Licensed under the BSD 2-Clause License", {"bsd-2-clause"}),
    ("Licensed under the BSD 3-Clause License", {"bsd-3-clause"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies.", {"isc"}),
]


def test_look_alike_licences(spark):
    rows = [(i, f"Some words before. {t} And after.") for i, (t, _) in enumerate(LOOK_ALIKES)]
    rows += [(1000 + i, t) for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(LOOK_ALIKES))] == [x for _, x in LOOK_ALIKES]
    assert [got[1000 + i] for i in range(len(licenses.TEMPLATES))] == [{x} for x in licenses.TEMPLATES]


def test_automaton_knows_every_run():
    texts = [[0, 1, 2, 0, 1, 3], [1, 2, 2, 0], [3, 3, 3]]
    sam = licenses.Automaton(texts)
    for t in texts:
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                assert sam.length[sam.find(t[a:b])] >= b - a


PERSONAL = [
    "a@b.c_d@e.f", "x@y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111",
    "4111 1111 1111 1111 1", "+1 (736) 555-1234 +49.30.123456", "a@b..c a@b.c. a.b@c-d.e-", "",
    "é😀 foo@bar.com é +12345678", "5" * 3000, "a" * 3000 + "@b.c", "x.y" * 900, "1 " * 900,
    "+" + "1 " * 900, "a@b" + ".c" * 900, "1.1.1." * 100, "+1-2", "9" * 16 + " " + "0" * 16]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_data(spark, corpus, tmp_path):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(PERSONAL)] + [(None, "me@x.org")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in
           pii.digest(pii.find(spark.read.parquet(str(tmp_path / "d")))).collect()}
    for i, t in rows:
        want = [f"{k}:{a}:{b}" for k, a, b in base_spans(t or "")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(",")) | {""}
        for k in pii.BASE:
            assert got[i][f"n_{k}"] == sum(x.startswith(k) for x in want)


def test_iban_context_and_mask(spark, tmp_path):
    rows = [(0, "my account DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, mail a@b.org!"),
            (1, "DE89370400440532013001"), (2, None), (3, "call +1 736 555 1234 now"),
            (4, "+1 736 555 1234")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert got[0].spans == "email:71:78,iban:11:33,iban:37:64" and got[1].spans == ""
    assert got[3].max_score > got[4].max_score > 0
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[0] == "my account [IBAN] or [IBAN], mail [EMAIL]!"
    assert masked[1] == rows[1][1] and masked[2] is None and masked[3] == "call [PHONE] now"
    assert pii.find(df.where("false")).collect() == []


def test_clashing_columns(spark, documents):
    assert licenses.scan(documents).count() == documents.count()
    assert wordpiece.token_counts(documents, tokenizer_path()).count() == documents.count()
    assert pii.mask(documents).columns == documents.columns


def test_rank_table_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    enc, tok = packing.Encoder(path), Tokenizer.from_file(path)
    assert enc.fast is not None
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "٣", "'s", "'ll", "’", "?!",
             "中", "😀", "<|endoftext|>", "\r\n", "\x00", "x" * 30, " " * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}  " for c in range(i, i + 997) if not 0xD800 <= c < 0xE000)
              for i in range(1, 0x20000, 997)]
    texts += [" " * 300000 + "a", "\n" * 300000 + "b c", "x" * 200000]       # beyond the fast form
    for t in texts:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
