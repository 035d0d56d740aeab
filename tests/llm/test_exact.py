"""Operators against brute force, exact round trips and the libraries they match."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bpe, decontam, minmax_dedup, pii, quality, secret_scan
from quire.llm.automata import infer
from quire.llm.common import WordCodes
from quire.llm.pretokens import GPT_PATTERN, Splitter
from quire.llm.queries import QUERIES
from quire.llm.token_shards import WaveletMatrix
from quire.llm.transducers import Transducer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert GPT_PATTERN == public_tokenizers.PATTERN


def test_splitter_equals_the_pattern():
    r, full, fast = random.Random(1), regex.compile(GPT_PATTERN).findall, Splitter().split
    for _ in range(5000):
        t = "".join(chr(r.choice([r.randrange(256), 32, 39, 10, 115, 0x85, 0xA0, 0x1C])) for _ in range(r.randrange(12)))
        assert fast(t) == full(t)


def test_bpe_equals_the_library(spark, docs, library):
    for r in QUERIES["op4_byte_bpe"](spark, SF).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_perfect_hash_is_minimal():
    for n in (0, 1, 5, 3000):
        keys = [str(i).encode() for i in range(n)]
        h = bpe.MinimalPerfectHash(keys)
        assert sorted(map(h.slot, keys)) == list(range(n))


def test_token_shards_equal_the_library(spark, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    got, start = {r.doc_id: r for r in QUERIES["op3_token_shards"](spark, SF).collect()}, 0
    for i in sorted(docs):
        ids = np.array(model.encode(docs[i], add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n,bits", [(0, 3), (1, 1), (7, 3), (4000, 5), (2500, 17)])
def test_wavelet_matrix(n, bits):
    r = random.Random(n)
    a = np.array([r.randrange(1 << r.randrange(1, bits + 1)) for _ in range(n)], np.uint32)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(a, bits).to_bytes())
    assert (w.ids() == a).all()
    assert all(w.access(i) == a[i] for i in range(0, n, max(1, n // 40)))
    for s in {0, 1, *a[:10].tolist()}:
        assert w.positions(s) == np.flatnonzero(a == s).tolist()
        assert w.rank(s, n // 2) == int((a[:n // 2] == s).sum())
    with pytest.raises(IndexError):
        w.select(0, n + 1)


def _sets(docs):
    out = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        out[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_near_duplicates_against_all_pairs(spark, docs):
    sets = _sets(docs)
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    for r in QUERIES["op2_minmax_near_dup"](spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_blocks_lose_no_link(spark, monkeypatch):
    """A group of chained near copies, cut into many blocks, is still one component."""
    monkeypatch.setattr(minmax_dedup, "BLOCK_SHINGLES", 150)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(words)
        words[r.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and sum(x.kept for x in got) == 1


def test_quality_base_measures(spark, docs):
    for r in QUERIES["op5_quality_rules"](spark, SF).collect():
        t = docs[r.doc_id]
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0
    p, n, k = quality.upper_bound(3, 50, 0.1), 50, 3
    from math import comb
    assert sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)) == pytest.approx(0.1, abs=1e-6)


def test_certified_cutoffs_hold_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r.doc_id: r.kept or r.base_failed for r in QUERIES["op5_quality_rules"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert 1 - sum(good) / len(good) <= quality.ALPHA
    assert 1 - sum(bad) / len(bad) > 0.45          # half of the others fail the base rules already


def test_wand_against_all_scores():
    r = random.Random(2)
    rows = [(i, "", [f"t{min(r.randrange(300), r.randrange(300))}".encode() for _ in range(r.randrange(5, 40))])
            for i in range(300)]
    df = collections.Counter(w for _, _, ws in rows for w in set(ws))
    index = decontam.build_index(rows, df, len(rows), 20.0)
    for _ in range(300):
        base = r.choice(rows)[2]
        q = {index.terms[w] for w in base[:r.randrange(1, len(base) + 1)]} | {r.randrange(len(index.terms)) for _ in range(9)}
        limit = r.choice([0.2, 0.5, 0.8])
        scores = np.zeros(len(rows))
        for t in q:
            scores[index.docs[t]] += index.impacts[t]
        got = dict(decontam.wand(index, np.array(sorted(q)), limit))
        assert got == pytest.approx({int(i): scores[i] for i in np.flatnonzero(scores >= limit - 1e-9)})


def test_decontamination_against_all_shingles(spark, docs):
    def shingles(t):
        w = [x.decode() for x in decontam.words_of(t.encode())]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    held = {i: shingles(t) for i, t in docs.items()}
    want = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = shingles(item.text)
        want |= {(i, item.item_id) for i, s in held.items() if len(own & s) >= 0.75 * len(own)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    assert got == want and got


def test_held_out_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, label[r.doc_id]) for r in QUERIES["op7_toxicity"](spark, sf).collect()
           if r.held_out and label.get(r.doc_id) is not None]
    good, bad = ([s for s, t in got if t == want] for want in (0, 1))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.93


def test_licences_of_planted_notices(spark):
    from quire.llm import licenses
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(plain)
    rows = [(-1, "one line\nReleased under the MIT License.", "mit"), (-2, "All rights reserved.", "reserved"),
            (-3, "Licensed under the Apache License, Version 2.0.\nmore", "apache"), (-4, "plain words only", "none")]
    got = licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.license.family for r in got} == {r[0]: r[2] for r in rows}


def test_licence_scan_makes_the_words_of_a_text_once(spark):
    from pyspark.sql import functions as F
    from quire.llm import licenses
    model = licenses.Model(["none", "mit"], {"mit": [0.0, 1.0]}, [0.0, 0.0], licenses.anchor_pairs(licenses.NOTICES), 0.5,
                           {"mit": licenses.NOTICES["mit"]})
    docs = spark.createDataFrame([(1, "x")], "doc_id long, body string")
    plan = licenses.scan(docs, model, "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(coalesce(body") == 1

    rows = [(["a", "b", "a", "b", "c"],), ([],), (["b"],), (["a", "c", "b", "a"],), (None,)]
    wanted = ["a b", "b a", "c d"]
    ws = spark.createDataFrame(rows, "ws array<string>")
    got = ws.select(licenses.pairs_among(F.col("ws"), wanted).alias("p"),
                    F.filter(licenses.pairs(F.col("ws")), lambda p: p.isin(wanted)).alias("q")).collect()
    assert [r.p for r in got] == [r.q for r in got] == [["a b", "b a", "a b"], [], [], ["b a"], None]


def test_licence_scan_runs_without_python(spark):
    from quire.llm import licenses
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = licenses.scan(docs, licenses.fit(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_secrets_base_spans(spark, docs):
    kinds = {"assign": re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"access": 16, "hex": 32}
    for r in QUERIES["op9_secret_scan"](spark, SF).collect():
        spans = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in p.finditer(docs[r.doc_id])
                 if (len(m[2]) >= 8 if k == "assign" else len(m[0]) >= least[k])]
        want = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
        assert r.base_sha256 == _digest(want) and set(want) <= set(r.spans.split(","))  | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in kinds)


def test_formats_find_what_has_no_name():
    r = random.Random(4)
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(200)]
    plain = ["".join(r.choice(["tion", "er", "the", "in", "and"]) for _ in range(6)) for _ in range(200)]
    model = secret_scan.train({"access": keys}, plain)
    text = f"see {keys[0][::-1]} or {'internationalisations'} then BKIA{keys[1][4:]}"
    found = [text[a:b] for k, a, b in secret_scan.find(text, model) if k == "format"]
    assert "internationalisations" not in found and "BKIA" + keys[1][4:] in found
    assert secret_scan.redact("a token=abcdefgh1 b", [("assign", 2, 17)]) == "a [SECRET] b"


def test_automaton_learns_a_format():
    a = infer(["dddd"] * 50 + ["ddddll"] * 50, {"d": 10, "l": 20})
    assert a.log_likelihood("dddd") > a.log_likelihood("ddd") and a.log_likelihood("xx") == -float("inf")


def test_personal_data_base_spans(spark, docs):
    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15)]
    texts = list(docs.values()) + ["a@b.c.@d.e x@y", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111-1111 1111", "+1 (2) 345-67.89 ()"]
    for t in texts:
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]
        assert pii.spans_text(pii.find(t), pii.BASE_KINDS) == ",".join(want)
    for r in QUERIES["op10_pii"](spark, SF).collect():
        assert r.base_sha256 == _digest([pii.spans_text(pii.find(docs[r.doc_id]), pii.BASE_KINDS)])


def test_personal_data_added_by_checksum_and_context():
    text = "account GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, order 123-45-6780, GB82 WEST 1234 5698 7654 33"
    spans = [(k, text[a:b]) for k, a, b, _ in pii.find(text)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in spans and ("id", "123-45-6789") in spans
    assert len([s for s in spans if s[0] == "iban"]) == 1


def test_transducers_compose():
    swap = Transducer.of([0], "ab", lambda s, a: (0, "b" if a == "a" else "a", 2.0))
    count = Transducer.of([0, 1], "ab", lambda s, a: (1 - s, a, 1.0 + s))
    assert swap.then(count).run("aab") == [("b", 2.0), ("b", 4.0), ("a", 2.0)]


def test_word_tables_start_anew():
    codes = WordCodes(limit=10)
    first = codes.hash_words([str(i).encode() for i in range(50)])
    assert (codes.hash_words([str(i).encode() for i in range(50)]) == first).all()


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
    bad = {r.doc_id for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids and not ids & bad
    text = "x token = \"0123456789abcdef0123456789abcdef01234567\" y"
    one = spark.createDataFrame([(1, text, "en", "s", len(text))], docs.schema)
    clean = corpus_pipeline.redact_secrets(spark, one, SF).first()
    assert "[SECRET]" in clean.text and "0123456789abcdef" not in clean.text and clean.n_chars == len(clean.text)


def test_ibans_end_at_their_country_length():
    german = "DE89 3704 0044 0532 0130 00"
    for text in (f"IBAN: {german} BIC: COBADEFFXXX", f"{german.replace(' ', '')} 2024-05-01", f"{german} EUR 100",
                 f"AB12 {german} NL91ABNA0417164300 GB82 WEST 1234 5698 7654 32 OK"):
        found = [text[a:b].replace(" ", "") for k, a, b, _ in pii.find(text) if k == "iban"]
        assert found[0] == german.replace(" ", "")
    assert found[1:] == ["NL91ABNA0417164300", "GB82WEST12345698765432"]
    assert not [s for s in pii.find("IBAN: DE89 3704 0044 0532 0130 01 BIC") if s[0] == "iban"]


def test_bare_credentials_do_not_lift_the_threshold():
    """Several percent of the long tokens outside base spans are credentials of a learned format."""
    r = random.Random(11)

    def key():
        return "sk" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))

    def word():
        return "".join(r.choice(["tion", "er", "the", "in", "and", "ous", "ly", "-", "/"]) for _ in range(r.randrange(7, 10)))

    def number():
        return "".join(r.choice("0123456789") for _ in range(26))

    for share in (0, 10, 30, 60):
        plain = [word() for _ in range(480 - share)] + [number() for _ in range(32)] + [key() for _ in range(share)]
        model = secret_scan.train({"assign": [key() for _ in range(300)]}, plain)
        assert sum(model.is_secret(key()) for _ in range(200)) >= 180
        assert sum(model.is_secret(word()) for _ in range(200)) <= 2
        assert sum(model.is_secret(number()) for _ in range(200)) <= 2


def test_token_shards_equal_the_untouched_library():
    from quire.llm.token_shards import Encoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        encoder = Encoder(f.read())
    model = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "中 <|endoftext|>", "plain a b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts] and got[1] == [50256]


def test_licences_in_wrapped_and_short_notices(spark):
    from quire.llm import licenses
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    header = ("# This program is free software: you can redistribute it and/or modify\n"
              "# it under the terms of the GNU General Public License as published by\n"
              "# the Free Software Foundation, either version 3 of the License, or\n"
              "# (at your option) any later version.\n#\nimport os\n")
    rows = [(1, "# a tool\n#\n" + header, "gpl"), (2, "Licensed under the GNU General Public License v3.0", "gpl"),
            (3, "x\n\nThe MIT License (MIT)\n\ny", "mit"), (4, "one of the many, to the end of the day\n" * 3, "none"),
            (5, "Released under the\nMIT License.", "mit"),
            (6, "any person may use this program free of charge, under the terms of house 7", "none")]
    hard = [(-i, f"any person may use this program free of charge, under the terms of house {i}\n"
                 f"member {i} may use the copy of this program under the terms of the house") for i in range(1, 200)]
    model = licenses.fit(plain.unionByName(spark.createDataFrame(hard, plain.schema)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, model).collect()}
    assert {i: x.family for i, x in got.items()} == {r[0]: r[2] for r in rows}
    assert all(x.n_paragraphs == (x.family != "none") for x in got.values())
