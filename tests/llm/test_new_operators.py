"""Packing, phrase mining and alignment against brute force and the libraries they match."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment, packing, phrases
from quire.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ------------------------------------------------------------------------------------ packing

def _padding(fills, window):
    return [0 if f & (f - 1) == 0 else window - f for f in fills]


def _check_packing(lengths, window, tolerance):
    packed = packing.pack_lengths(np.array(lengths, np.int64), window, tolerance)
    pieces = defaultdict(list)
    for sequence in packed:
        for p in sequence:
            pieces[p.doc].append((p.start, p.length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == n
    fills = [sum(p.length for p in s) for s in packed]
    assert all(0 < f <= window for f in fills) and max(_padding(fills, window), default=0) <= tolerance
    return packed


@pytest.mark.parametrize("seed", range(8))
def test_packing_loses_nothing_and_pads_little(seed):
    r = random.Random(seed)
    window = r.choice([1, 2, 7, 64, 100, 2048])
    high = r.choice([1, 5, window, 5 * window])
    _check_packing([r.randrange(1, high + 1) for _ in range(r.choice([0, 1, 2, 30, 700]))], window, r.choice([0, 1, 5]))


@pytest.mark.parametrize("length", [1, 1023, 1025, 1100, 2047, 2048, 2049, 5000])
def test_packing_of_equal_lengths(length):
    _check_packing([length] * 333, 2048, 16)


def test_windows_are_the_tightest():
    r = random.Random(5)
    for _ in range(60):
        window = r.randrange(1, 40)
        lengths = np.array([r.randrange(1, window + 1) for _ in range(r.randrange(40))], np.int64)
        room = []                                            # remaining capacities, by trying all windows
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [c for c in room if c >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(window - n)
        got = packing.best_fit_decreasing(lengths, window)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert sorted(window - int(lengths[w].sum()) for w in got) == sorted(room)


def test_whole_short_documents_stay_whole_where_they_fit():
    packed = _check_packing([1500, 500, 48, 2000, 48], 2048, 0)
    assert sorted(len(s) for s in packed) == [2, 3] and all(p.start == 0 for s in packed for p in s)


def test_packed_ids_equal_the_library(spark, docs):
    model = Tokenizer.from_file(BYTES)
    got, by_sequence = defaultdict(list), defaultdict(list)
    for r in QUERIES["op11_packing"](spark, SF).collect():
        got[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in docs:
        ids, at = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    fills = []
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) <= 2048 and max(_padding(fills, 2048)) <= packing.TOLERANCE


def test_sequences_are_joined_and_padded(spark, docs):
    df = spark.createDataFrame(docs[:40] + [(1000, None)], "doc_id long, text string")
    pieces = packing.pack(df, BYTES, window=100, tolerance=5, block_tokens=3000)
    rows = packing.sequences(pieces, window=100, pad_id=9).collect()
    held = {r.sequence_id: [] for r in rows}
    for p in pieces.collect():
        held[p.sequence_id].append(p)
    for r in rows:
        ids = b"".join(bytes(p.ids) for p in sorted(held[r.sequence_id], key=lambda p: p.offset))
        assert bytes(r.ids[:len(ids)]) == ids and len(ids) == 4 * r.n_tokens
        full = r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 100
        assert len(r.ids) == 4 * full and set(np.frombuffer(r.ids[len(ids):], "<u4").tolist()) <= {9}


# ------------------------------------------------------------------------------------ phrases

def _mined(docs, support, top=2000):
    """The contract, read word by word."""
    n, f = Counter(), Counter()
    for language, text in docs:
        language = "und" if language is None else language
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[language] += len(words)
            f.update((language, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    for (language, words), a in candidates.items():
        score, k = min((2000000 * a // (f[language, words[:k]] + f[language, words[k:]]), k) for k in range(1, len(words)))
        longer = [b for (other, w), b in candidates.items() if other == language and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w)))]
        if all(100 * b < 80 * a for b in longer):
            out.append((language, score, a, " ".join(words), f[language, words[:k]], f[language, words[k:]]))
    rows, rank = [], Counter()
    for language, score, a, phrase, left, right in sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode())):
        rank[language] += 1
        if rank[language] <= top:
            rows.append((language, rank[language], phrase, a, left, right, n[language], score))
    return rows


def _random_texts(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "b", "ä", "中文", "x\xa0y", "new", "York", "\x00", "und", "é"]
    marks = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", "! ", " "]
    texts = ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(25))) for _ in range(n)]
    return [(r.choice(["en", "de", None, "und", ""]), t) for t in texts] + [("en", None), ("en", ""), (None, " \t. "),
                                                                           ("hot", "to be or not to be " * 300)]


@pytest.mark.parametrize("support,shards,bits", [(1, 1, 16), (4, 2, 16), (5, 5, 12), (7, 3, 20), (30, 6, 8)])
def test_collocations_against_counting_everything(spark, support, shards, bits):
    """With a small bitmap nearly all phrases are counted in the second pass, and the result is the same."""
    rows = _random_texts(support, 400)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = phrases.collocations(df, support=support, top=40, shards=shards, filter_bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(_mined(rows, support, top=40))


def test_collocations_in_small_blocks(spark, monkeypatch):
    """Blocks end within a language's words of a task, and word codes start anew."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 500)
    rows = _random_texts(9, 300)
    texts = [(lang, (t or "").encode()) for lang, t in rows]
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"lang": [a or "und" for a, _ in texts[i:i + 20]],
                                           "text": pa.array([b.decode() for _, b in texts[i:i + 20]])})
               for i in range(0, len(texts), 20)]
    found, blocks = Counter(), 0
    for table, language, codes in phrases._blocks(iter(batches)):
        blocks += 1
        table.limit = 4
        for n, at, counts in phrases.counted(codes, 4):
            for i, c in zip(at.tolist(), counts.tolist()):
                found[language, tuple(table.words[k] for k in codes[i:i + n].tolist())] += c
    assert blocks > 10
    want = Counter()
    for language, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x.encode() for x in re.findall(r"[^\x20\x09]+", piece)]
            want.update((language or "und", tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == want


def test_collocations_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op12_phrases"](spark, SF).collect())) == sorted(con.execute(SQL["op12_phrases"]).fetchall())


def test_scores_beyond_64_bits(spark):
    a, left, right = 8 * 10**18, 9 * 10**18, 9 * 10**18 + 7
    rows = [("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y z", 3, a * 79 // 100),
            ("en", "y z", 2, a), ("en", "z", 1, left)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    got = {r.phrase: r.score for r in phrases.score(frequent).collect()}
    assert got["x y"] == 2000000 * a // (left + right)
    assert {r.phrase for r in phrases.covered(frequent).collect()} == set()
    assert {r.phrase for r in phrases.covered(frequent, 79).collect()} == {"x y", "y z"}


# ------------------------------------------------------------------------------------ alignment

def _aligned(docs):
    """Groups, links and corpus-wide counts by going through tokens one by one."""
    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    alphabet = alignment._byte_level_alphabet()
    spell_a = {i: bytes(alphabet[c] for c in t) for t, i in a_model.get_vocab().items() if all(c in alphabet for c in t)}
    spell_b = [alignment._piece_bytes(b_model.id_to_piece(i)) for i in range(b_model.get_piece_size())]
    count, found = Counter(), {}
    for key, text in docs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(spell_a[i] for i in a) != raw or b"".join(spell_b[i] for i in b) != raw:
            a = b = []
        cuts = sorted(set(np.cumsum([len(spell_a[i]) for i in a]).tolist()) & set(np.cumsum([len(spell_b[i]) for i in b]).tolist()))
        groups = [([], []) for _ in cuts]
        for side, ids, spell in ((0, a, spell_a), (1, b, spell_b)):
            at = g = 0
            for i in ids:
                groups[g][side].append(i)
                at += len(spell[i])
                g += at == cuts[g]
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        count.update(links.keys())
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        found[key] = len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if a else ""
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return {k: (na, nb, ng, sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]),
                sum(m * count[p] for p, m in links.items()), digest) for k, (na, nb, ng, links, digest) in found.items()}


def _odd_texts():
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "中", "\U0001F600", "<|endoftext|>", "<s>", "ing", "the", " the", "1", "23",
             ".", "\x00", "--", "    ", "ﬁ", "'s", "ā", "é", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)]
    return texts + ["▁", "a▁b", None, "", "   ", "\n", " " * 1000, "中" * 500, "x" * 3000, "ab " * 4000]


@pytest.mark.parametrize("common", [1 << 20, 60, 0])
def test_alignment_of_odd_texts(spark, common):
    docs = list(enumerate(_odd_texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.link_counts(df, BYTES, PIECES, common_pairs=common).collect()}
    assert got == _aligned(docs)


def test_alignment_of_the_table(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, SF).collect()}
    assert got == _aligned(docs)


@pytest.mark.parametrize("products", [1, 7, 1 << 20])
def test_row_products(monkeypatch, products):
    monkeypatch.setattr(alignment, "PRODUCTS", products)
    r = np.random.default_rng(products)
    for n, k, m in ((0, 3, 2), (4, 1, 5), (13, 9, 11)):
        x, y = r.integers(0, 3, (n, k)) * r.integers(0, 2, (n, k)), r.integers(0, 3, (k, m)) * r.integers(0, 2, (k, m))
        a, b = (alignment.Csr.of(*np.nonzero(z), z[np.nonzero(z)], *z.shape) for z in (x, y))
        got = np.zeros((n, m), np.int64)
        for rows, columns, values in a.dot(b):
            got[rows, columns] += values
        assert (got == x @ y).all()
        back = np.zeros((k, n), np.int64)
        t = a.transposed()
        back[t.rows(), t.columns] = t.values
        assert (back == x.T).all()
