"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinemill.llm import chat, fingerprints, jpeg, near, pieces, spans, token_counts, warc, word_bpe
from kinemill.llm.common import offsets, tokenizer_path
from kinemill.llm.language import UNDETERMINED, held_out, identify, sample_texts, train
from kinemill.llm.packing import Packer, pack_documents
from kinemill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, fingerprint string, n_tokens int"
ODD = ["", " ", "  a", "▁a ▁ b", "a\n\nb \n c", "😀 你好 \x00 x", "aaaa aaaaaaaa bbbb", "é​ x", "\n", "ΣΑΣ <|endoftext|> it's I'LL 12½", "a\x1cb", "İstanbul \x85y", "x" * 30_000, "word. " * 9000]


def docs(spark, rows):
    """Rows (id, text) with more columns, of which some have the names of results."""
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (99, None), (3, ODD[3]), (3, "another text of the same id")]
    return docs(spark, rows)


def test_odd_rows_and_empty_tables(spark, odd):
    empty = docs(spark, [])
    runs = {
        "count": lambda d: token_counts.count_tokens(d, PIECE), "prints": fingerprints.with_edits, "spans": spans.dedup_spans, "pack": lambda d: pack_documents(d, WORD), "pieces": lambda d: pieces.digest_documents(d, PIECE),
        "near": near.link, "one": near.one_of_each, "jpeg": lambda d: jpeg.read_texts(jpeg.store_texts(d)), "lang": lambda d: identify(d, train(d), d.columns),
    }
    n = odd.count()
    for name, run in runs.items():
        got = run(odd).count()
        assert got == n or name in ("pack", "one"), name
        assert run(empty).count() == 0, name


# ---- Tokens ----------------------------------------------------------------------------------------------


def test_longest_match_is_greedy(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    vocab = {sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest = max(map(len, vocab))

    def brute(word):
        b, n = ("▁" + word).encode(), 0
        while b:
            k = next((k for k in range(min(longest, len(b)), 1, -1) if b[:k] in vocab), 1)
            b, n = b[k:], n + 1
        return n

    sample = [t or "" for _, t in texts[:40]] + [t for t in ODD if len(t) < 1000]
    words, tokens = token_counts.counter(PIECE)(sample)
    split = [re.findall(r"[^\x00-\x20]+", t) for t in sample]
    assert words.tolist() == [len(s) for s in split]
    assert tokens.tolist() == [sum(map(brute, s)) for s in split]


def test_sentencepiece_equals_the_library(texts):
    import sentencepiece

    sp, coder = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.pieces(PIECE)
    rng = random.Random(1)
    sample = [t or "" for _, t in texts] + ODD + ["".join(rng.choice("abcdeinrst  \n.▁é") for _ in range(rng.randrange(60))) for _ in range(1000)]
    ids, sizes = coder.encode(sample)
    at = offsets(sizes)
    for i, (t, raw, dec) in enumerate(zip(sample, coder.decode(ids, sizes), coder.decimals(ids, sizes), strict=True)):
        want = sp.encode(t, add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert raw.decode() == sp.decode(want) and dec == b" ".join(b"%d" % k for k in want)


def test_word_bpe_equals_the_library(texts):
    coder = word_bpe.word_bpe(WORD)
    sample = [t or "" for _, t in texts] + ODD
    ids, sizes = coder.encode(sample)
    at = offsets(sizes)
    for i, t in enumerate(sample):
        assert ids[at[i] : at[i + 1]].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_places_each_id_once(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    got = QUERIES["op5_packing"](spark, DATA).toPandas()
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() == len(want[i]) == g["doc_tokens"].iloc[0]
        assert g["ids_crc32"].tolist() == [zlib.crc32(want[i][s : s + n]) for s, n in zip(g["start"], g["length"], strict=True)]
    assert set(got["doc_id"]) == set(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        n = int(g["length"].sum())
        assert n == 4096 or (n < 4096 and n & (n - 1) == 0)


def test_packer_balances_costs():
    packer = Packer(100, 1.0, 0.01)
    rng = random.Random(5)
    pieces_, left = packer.pack([(k, 0, rng.randrange(1, 40)) for k in range(400)], last=False)
    costs = list(packer.costs.values())
    assert max(costs) / min(costs) < 1.6 and sum(x[2] for x in left) < 100


# ---- Fingerprints, spans, near copies ----------------------------------------------------------------------


def test_edited_texts(spark, texts):
    got = QUERIES["op2_syncmer_fingerprints"](spark, DATA).toPandas().set_index("doc_id")
    order = texts[::-1]
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got.loc[i, "edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got.loc[i, "n_chars"] == len(t)
    assert got["near_edited"].mean() > 0.4 and got["near_next"].mean() < 0.1


def test_syncmers_are_context_free_and_alike():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    body = " ".join(word() for _ in range(400))
    a, b, c = fingerprints.fingerprints([body, " ".join(word() for _ in range(400)) + " " + body, " ".join(word() for _ in range(400))])
    assert fingerprints.likeness(a, a) == 1.0 and 0.4 < fingerprints.likeness(a, b) < 0.9 and fingerprints.likeness(a, c) < 0.05
    assert fingerprints.likeness(b"", b"") == 1.0 and fingerprints.likeness(a, b"") == 0.0


def anchors_by_hand(raw):
    """Closed syncmers one k-mer at a time."""
    mask, m1, m2 = (1 << 64) - 1, int(fingerprints._M1), int(fingerprints._M2)
    eight = lambda i: int.from_bytes(raw[i : i + 8], "little")

    def first(i):
        h = eight(i) * m1 & mask
        return (h ^ h >> 32) * m2 & mask

    out = []
    for i in range(len(raw) - fingerprints.K_MER + 1):
        inner = [first(i + k) >> 32 for k in range(fingerprints.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            h = first(i) ^ (first(i + 8) * m1 & mask) ^ (first(i + fingerprints.WINDOW - 1) * m2 & mask)
            out.append((h ^ h >> 29) * m1 + 0 & mask)
    return [h >> 32 for h in out]


def test_fingerprints_equal_brute_force(texts):
    sample = [t or "" for _, t in texts[:25]] + [t for t in ODD if len(t) < 20_000]
    for t, got in zip(sample, fingerprints.fingerprints(sample), strict=True):
        raw = t.encode()
        place = {}
        for k, mark in enumerate(anchors_by_hand(raw)):
            place.setdefault(mark, k)
        if place:
            kept = sorted(place)[: fingerprints.LEAST + len(place) // fingerprints.SHARE]
            assert np.frombuffer(got, ">u4").tolist() == sorted(kept, key=place.get)
        else:
            assert len(got) == (4 if raw else 0)


def test_likeness_of_long_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    for n in (200, 20_000):  # half of a text replaced, at any length
        a = [word() for _ in range(n)]
        x, y = fingerprints.fingerprints([" ".join(a), " ".join(a[: n // 2] + [word() for _ in range(n // 2)])])
        assert abs(fingerprints.likeness(x, y) - 0.5) < 0.12


def test_neighbours_by_id_with_nulls(spark):
    rows = [(k if k % 3 else None, f"text {k} " * 20) for k in range(60)] + [(7, "another text with the id seven"), (None, None)]
    got = fingerprints.with_edits(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and got["edited_sha256"].notna().all()
    known = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: -r[0])
    by = defaultdict(set)
    for i, h in zip(got["doc_id"], got["edited_sha256"], strict=True):
        by[None if np.isnan(i) else int(i)].add(h)
    for (i, t), (_, after) in zip(known, known[1:], strict=False):
        if 7 not in (i, _):
            assert hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest() in by[i]


def test_cuts_are_searched_in_two_steps(spark):
    cuts = [1.0, 2.0, 2.5, 7.0, 9.0, 11.0, 30.0]
    values = [-1.0, 1.0, 1.5, 2.5, 8.0, 30.0, 99.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fingerprints.above(cuts, F.col("v")).alias("n")).collect()
    assert [r["n"] for r in got] == [sum(c > v for c in cuts) for v in values]


def test_passages_of_fifty_words_stay_once(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join([sentence(24), sentence(3), sentence(26), sentence(2)])
    clean = [" ".join(sentence(9) for _ in range(12)) for _ in range(6)]
    rows = [(k, f"{c[: c.find('.') + 1]} {passage} {c[c.find('.') + 2 :]}" if k < 5 else c) for k, c in enumerate(clean)]
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[5] == rows[5][1]
    for k in range(1, 5):
        assert got[k].split() == clean[k].split()


def test_passages_that_begin_in_mid_sentence_go(spark):
    """51 shared words, the end of one sentence and the beginning of the next, or without a full stop at all."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, shared = [], []
    for k in range(40):
        words = [word() for _ in range(51)]
        if k % 2:
            words[24] += "."
        shared.append(" ".join(words))
        for copy in range(2):
            rows.append((2 * k + copy, f"{' '.join(word() for _ in range(8 + k % 5))} {shared[k]} {' '.join(word() for _ in range(9))}."))
    got = {r["doc_id"]: r for r in spans.dedup_spans(docs(spark, rows)).collect()}
    hit = 0
    for k in range(40):
        assert got[2 * k]["text"] == rows[2 * k][1] and got[2 * k]["n_removed"] == 0
        left, own = got[2 * k + 1]["text"].split(), set(shared[k].split())
        assert [w for w in rows[2 * k + 1][1].split() if w not in own] == [w for w in left if w not in own]
        hit += sum(w in own for w in left) <= 31
    assert hit >= 39


def spans_by_hand(rows, least=spans.LEAST_WORDS):
    """Texts without repeated runs, by sets of word tuples."""
    cut = {i: spans.Sentences([t], 1) for i, t in rows}  # its sentences; runs, hashes and removal are made here
    first, runs = {}, {}
    for i, t in sorted(rows):
        words, s = t.split(), cut[i]
        at = [*s.first.tolist(), len(words)]
        n = len(at) - 1
        mine = set()
        for a in range(n):
            b = next((b for b in range(a + 2, n + 1) if at[b] - at[a] >= least), None)
            if b:
                mine.add((a, b))
        for b in range(1, n + 1):
            a = next((a for a in range(b - 2, -1, -1) if at[b] - at[a] >= least), None)
            if a is not None:
                mine.add((a, b))
        runs[i] = sorted(mine), at, [w.lower() for w in words]
        for a, b in runs[i][0]:
            first.setdefault(tuple(runs[i][2][at[a] : at[b]]), (i, a))
    out = {}
    for i, (mine, at, low) in runs.items():
        gone = {s for a, b in mine if first[tuple(low[at[a] : at[b]])] != (i, a) for s in range(a, b)}
        out[i] = [w for s in range(len(at) - 1) if s not in gone for w in low[at[s] : at[s + 1]]], len(gone)
    return out


def test_spans_equal_brute_force(spark, texts):
    rows = [(i, t) for i, t in texts if t and t.isascii()]
    want = spans_by_hand(rows)
    got = spans.dedup_spans(docs(spark, rows)).collect()
    assert sum(n for _, n in want.values()) > 0
    for r in got:
        assert (r["text"].lower().split(), r["n_removed"]) == want[r["doc_id"]]


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_of_other_types(spark, kind):
    passage = ". ".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(9)) + "."
    rows = [("10" if kind == "string" else 10.0, passage), ("9" if kind == "string" else 9.0, passage + " More."), (None, "lone words here")]
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = {r["doc_id"]: r for r in spans.dedup_spans(d).collect()}
    assert len(got) == 3 and sum(r["n_removed"] > 0 for r in got.values()) == 1
    linked = {r["doc_id"]: r["class_id"] for r in near.link(d).collect()}
    assert linked[rows[0][0]] == linked[rows[1][0]] == min(rows[0][0], rows[1][0]) and linked[None] is None
    assert {r["doc_id"] for r in near.one_of_each(d).collect()} == {min(rows[0][0], rows[1][0]), None}
    if kind == "string":
        assert chat.read_back(chat.expand(d.selectExpr("doc_id conv_id", "0 turn", "'assistant' role", "text"))).count() == 3


def test_rows_that_share_an_id_stay_if_they_differ(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    got = near.one_of_each(docs(spark, [(5, a), (5, b), (6, c), (3, a), (6, c), (None, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, a), (5, b), (6, c)])


def test_clashing_names(spark):
    """Columns with the names that results and helpers have."""
    text = ". ".join(" ".join(f"w{k}x{j}" for j in range(9)) for k in range(9)) + "."
    names = ["score", "lang_pred", "held_out", "doc", "h", "c", "k", "t1", "t2", "turn", "n_removed", "n_sentences", "text_", "hash", "range", "extra", "node", "l", "t", "_lang_pred", "_score"]
    d = spark.createDataFrame([(i, text, "en", *(["x"] * len(names))) for i in range(3)], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long")), DATA)
        assert out.columns == [*d.columns, "source", "n_chars"], name
        assert out.where("score = 'x' and k = 'x'").count() == (1 if name == "ngram_jaccard" else 3), name
    assert fingerprints.with_edits(d).count() == identify(d, train(d), d.columns).count() == near.link(d).count() == 3


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_take_odd_and_empty_input(spark, stage):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", None, 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (0, "", None, "s", 0), (7, ODD[7], "fr", "s", 1), (7, ODD[7], "fr", "s", 1)]
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, spark.createDataFrame([], schema), DATA).count() == 0
    got = run(spark, spark.createDataFrame(rows, schema), DATA).collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    elif name == "substring_dedup":
        assert len(got) == len(rows)
    elif name == "ngram_jaccard":
        assert len(got) == len({re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(re.findall(r"[^\x00-\x20]+", r[1] or ""))) for r in rows})


def test_links_and_classes_equal_brute_force(spark, texts):
    rng, rows = random.Random(4), list(texts)
    for k in range(60):  # groups of near copies
        i, t = texts[rng.randrange(20)]
        words = (t or "").split()
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = f"w{k}"
        rows.append((10_000 + k, " ".join(words)))
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    grams, member = {}, defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x20]+", low(t or ""))
        grams[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        member[grams[i]].append(i)
    copy = {i: min(member[g]) for i, g in grams.items()}
    own = {min(v): g for g, v in member.items()}
    common = Counter()
    index = defaultdict(list)
    for i, g in own.items():
        for x in g:
            index[x].append(i)
    for v in index.values():
        common.update((a, b) for k, a in enumerate(v) for b in v[:k])
    root, links = {i: i for i in own}, Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(own[a]) + len(own[b]) - n):
            links[a] += 1
            links[b] += 1
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    for block in (512, 7):  # also with prefixes that are cut into many blocks
        for r in near.link(docs(spark, rows), block=block).collect():
            i = r["doc_id"]
            assert (r["copy_id"], r["class_id"], r["n_links"], r["n_grams"]) == (copy[i], top(copy[i]), links[copy[i]], len(grams[i]))


def test_prefix_length_meets_the_recall():
    k = near.prefix_length()
    assert 1 - (1 - 0.8**k) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near.TREES


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 4), (7, 7)], "u long, v long")
    assert {(r["node"], r["root"]) for r in near.components(e).collect()} == {(2, 1), (3, 1), (4, 1), (5, 1), (9, 8)}


# ---- Archives and media ------------------------------------------------------------------------------------


def test_warc_reads_back(spark, tmp_path):
    big, small = "x" * 100, "y"
    rows = [(5, "http://b.com/x", big), (2, "http://a.com/?b=1&a=2", big), (7, None, small), (8, "u\r\nv", small), (9, "http://a.com/", None), (None, "http://a.com/", big), (2, "http://a.com/?b=1&a=2", big), (11, "http://w.com/é", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = warc.round_trip(pages, f"file://{tmp_path}").orderBy("position").collect()
    assert len(got) == len(rows)
    assert [(r["url_key"], r["capture_time"], r["page_id"] is not None, r["page_id"] or 0) for r in got] == sorted((r["url_key"], r["capture_time"], r["page_id"] is not None, r["page_id"] or 0) for r in got)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "revisit", 2), (2, "response", None), (2, "response", None), (5, "revisit", 2), (7, "response", None), (8, "response", None), (9, "response", None), (11, "response", None)]
    want = {i: (h or "").encode() for i, _, h in rows}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len(want[r["page_id"]]), hashlib.sha256(want[r["page_id"]]).hexdigest()) for r in got)
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    # each entry's offset is where its record's member begins, and gzip reads the whole archive
    for r in got:
        data = open(f"{tmp_path}/archives/{r['archive']}", "rb").read()
        fields, _ = warc.parse_record(warc.record_at(data, r["offset"])[0])
        assert fields["warc-type"] == r["record_type"] and fields["warc-payload-digest"] == f"sha256:{r['payload_digest']}"
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= 1


def test_warc_bounds_archives_and_ranges(spark, tmp_path):
    rng = random.Random(6)
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.com/{k % 3}", rng.randbytes(300).hex()) for k in range(400)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/a", archive_bytes=5000)
    files = list((tmp_path / "a").rglob("part-*"))
    assert len(files) > 20 and max(f.stat().st_size for f in files) < 7000
    got = warc.merge_runs(warc.index_runs(spark, f"file://{tmp_path}/a"), range_rows=30).orderBy("position").collect()
    keys = [(r["url_key"], r["capture_time"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 400


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(8):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_jpeg_is_lossless_and_other_decoders_read_it(spark):
    rng = random.Random(2)
    for n in (192, 384, 192 * 33):
        p = bytes(rng.randrange(256) for _ in range(n))
        height, width, parts, quant, _ = jpeg.coefficients(media := jpeg.encode_payload(p, n))
        assert jpeg.payload_of(parts, n) == p
        rgb = jpeg.to_rgb(height, width, parts, quant)
        jvm = spark._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(media)))
        assert (image.getWidth(), image.getHeight()) == (width, height)
        # luma alone: decoders differ in how they smooth chroma
        theirs = np.array([[(image.getRGB(x, y) >> 8) & 255 for x in range(8)] for y in range(8)])
        assert rgb.shape == (height, width, 3) and abs(theirs - rgb[:8, :8, 1].astype(int)).mean() < 40


def test_jpeg_general_scans():
    """Zero runs, ends of blocks and new coefficients in a later scan, from a hand-made stream."""
    bits = lambda s: jpeg._packed(np.array([int(c) for c in s if c in "01"], np.uint8))
    spec = bytes([0, 0, 0, 6] + [0] * 12) + bytes([0x00, 0x01, 0x11, 0x21, 0x02, 0xF0])  # 4-bit codes 0..5
    dc = bytes([0, 0, 0, 3] + [0] * 12) + bytes([0, 1, 2])
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + b"\x02" * 64) + jpeg._segment(0xC4, b"\x00" + dc + b"\x10" + spec) + jpeg._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    first = bits("0010 11 0000")  # two blocks: DC 3, then the same
    ac = bits("0001 1  0011 0  0000   0101 0001 1 0000")  # block 0: k1=1, k4=-1, end; block 1: 16 zeros, k17=1, end
    later = bits("0010 1 1  0000 1   0000 0")
    media = head + jpeg._scan_header([1], 0, 0, 0, 0) + first + jpeg._scan_header([1], 1, 63, 0, 1) + ac + jpeg._scan_header([1], 1, 63, 1, 0) + later + b"\xff\xd9"
    _, _, [part], _, _ = jpeg.coefficients(media)
    zz = part.coefs.reshape(2, 64)
    assert zz[:, 0].tolist() == [3, 3]
    # 0x11 in the later scan: past one zero, correcting k1 on the way, a new +1 at k3; then k4 is corrected
    assert zz[0, 1:6].tolist() == [3, 0, 1, -3, 0] and zz[1, 17] == 2


# ---- Languages and chats -----------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op8_language"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got["lang_pred"] == got["lang"])[got["held_out"]].mean() > 0.97 and got["score"].between(0, 1).all()


def test_undetermined(spark):
    d = spark.createDataFrame([(1, "bonjour le monde", "fr"), (2, "hello the world", "en"), (3, None, "en"), (4, "123 --", "en"), (5, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(d, train(d), ["doc_id"]).collect()}
    assert got[1] == "fr" and got[2] == "en" and got[3] == got[4] == got[5] == UNDETERMINED
    assert d.where(held_out(F.lit(None))).count() == 0


def test_copies_do_not_thin_the_training_texts(spark):
    rows = [("en", "the same text")] * 20_000 + [("en", f"text number {k}") for k in range(1000)] + [("fr", f"texte {k % 3}") for k in range(9000)]
    d = spark.createDataFrame(rows, "lang string, text string")
    for most, want in ((12_000, {"en": 600, "fr": 3}), (20, {"en": 10, "fr": 3})):
        seen = [(r["l"], r["t"]) for r in sample_texts(d, 600, most, "text", "lang").collect()]
        assert Counter(k for k, _ in seen) == want and len(set(seen)) == len(seen)


def test_pipeline_rejects_what_is_no_learned_language(spark):
    import corpus_pipeline

    rng = random.Random(12)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    odd = [letters(n, "abcdefghijklmnopqrstuvwxyz   ") for n in (200, 400, 2000)] + [base64.b64encode(rng.randbytes(n)).decode() for n in (200, 400, 2000)]
    odd += ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * n for n in (1, 9)]
    whole = [r["text"] for r in d.where("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    clean = [" ".join(t.split()[:n]) for t, n in zip(whole, [1, 2, 3, 5, 8, 13, 50, 200] * 5, strict=True)]
    more = spark.createDataFrame([(800_000 + k, t, None, "s", len(t)) for k, t in enumerate(odd)] + [(900_000 + k, t, None, "s", len(t)) for k, t in enumerate(clean)], d.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, d.unionByName(more), DATA).select("doc_id").collect()}
    assert not kept & set(range(800_000, 800_000 + len(odd)))
    assert kept == {r["doc_id"] for r in d.select("doc_id").collect()} | {900_000 + k for k, t in enumerate(clean) if re.search(r"[^\W\d_]", t)}


def formatted(turns):
    return "".join(f"### {chat.escape_role(r or '')}: {chat.escape(t or '')}</turn>\n" for r, t in turns)


def test_chat_round_trip(spark, tmp_path):
    says = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", says), (-7, 1, "assistant", says), (1, 0, None, "a"), (1, 1, "as:#sist\nant", None), (1, 2, "assistant", "##"), (1, 3, "assistant", "### x: </turn>\n"), (1, 4, "user", "tail\\"), (1, 5, "user", "#### Heading"), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, None, "assistant", "é" * 2000), (3, 0, "user", "##### five"), (3, 1, "assistant", "#" * 9 + "</turn></turn>"), (3, 1, "assistant", "#" * 9 + "</turn></turn>")]
    c = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    for row_chars in (10, 1_000_000):
        expanded = chat.expand(c, row_chars=row_chars)
        expanded.repartition(7).write.parquet(out := f"{tmp_path}/{row_chars}")
        got = {r["conv_id"]: r for r in chat.read_back(spark.read.parquet(out)).collect()}
        straight = {r["conv_id"]: r for r in chat.read_back(expanded, in_order=True).collect()}
        assert got == straight
        whole = expanded.collect()
        for k, own in {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}.items():
            all_turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
            loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
            assert (got[k]["n_turns"], got[k]["turns_sha256"]) == (len(own), hashlib.sha256(all_turns.encode()).hexdigest())
            assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            mine = sorted((w for w in whole if w["conv_id"] == k), key=lambda w: (w["example"], w["part"]))
            assert got[k]["formatted_chars"] == sum(len(w["text"]) for w in mine)
            # every example is all turns up to its reply
            replies = [i for i, r in enumerate(own) if r[2] == "assistant"]
            for e, i in enumerate(replies):
                parts = [w for w in mine if w["example"] == e]
                assert "".join(w["text"] for w in parts) == formatted([r[2:] for r in own[: i + 1]])
                end = parts[-1]
                assert chat.unescape(end["text"][end["loss_start"] : end["loss_end"]]) == (own[i][3] or "") and end["text"][end["loss_end"] :] == "</turn>\n"
            rest = own[(replies[-1] + 1 if replies else 0) :]
            assert "".join(w["text"] for w in mine if not w["is_example"]) == formatted([r[2:] for r in rest])
    assert chat.read_back(chat.expand(c.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("#\\</turn>: \nab", max_size=12), st.text("#\\</turn>: \nab", max_size=30)), max_size=5))
def test_chat_template_is_reversible(turns):
    assert [(r, t) for r, t, _, _ in chat.parse(formatted(turns))] == turns


def test_chat_query_equals_brute_force(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect()
    says = r"\### Assistant: </turn> ok"
    own = defaultdict(list, {-7: [("user", says), ("assistant", says)]})
    for r in c:
        own[r["conv_id"]].append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in QUERIES["op9_chat_format"](spark, DATA).collect()}
    assert set(got) == set(own)
    for k, turns in own.items():
        ends = [i + 1 for i, (r, _) in enumerate(turns) if r == "assistant"]
        assert got[k]["formatted_chars"] == sum(len(formatted(turns[:e])) for e in ends) + len(formatted(turns[(ends or [0])[-1] :]))
        assert got[k]["loss_sha256"] == hashlib.sha256("".join(t or "" for r, t in turns if r == "assistant").encode()).hexdigest()
        assert got[k]["n_turns"] == len(turns) and got[k]["n_examples"] == len(ends)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(900_001, "12 34 --", None, "s", 8), (900_002, d.where("doc_id = 3").first()["text"], "en", "s", 1)], d.schema)
    kept = corpus_pipeline.language(spark, d.unionByName(more), DATA)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in d.select("doc_id").collect()} | {900_002}
    once = corpus_pipeline.near_duplicates(spark, kept, DATA)
    classes = {r["class_id"] for r in near.link(kept).collect()}
    assert {r["doc_id"] for r in once.collect()} == classes and 900_002 not in classes
    cut = corpus_pipeline.repeated_passages(spark, once, DATA)
    assert cut.columns == d.columns and cut.count() == once.count() and cut.where("n_chars <> char_length(text)").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() > 0
