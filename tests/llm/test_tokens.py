"""Packing, token files and SentencePiece against the libraries themselves."""

import hashlib
import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import packing, sentpiece, tokenfiles
from corpusflow.llm.common import shared_dir
from tests.llm.fixtures import SF, documents


def _ids(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def _u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_packing_whole_and_gapless(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs, with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = defaultdict(int)
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, lo in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[lo : lo + 1024 if k else first]
            expected[r["doc_id"], k, lo, len(part), zlib.crc32(_u4(part))] += 1
    seen, bins = defaultdict(int), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == expected
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def planned(lengths, caps):
    """Bins of plan_bins as lists of (offset, length), every piece placed by its length and rank."""
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.plan_bins(histogram, caps)
    bins = defaultdict(list)
    for length, n in histogram.items():
        own = np.flatnonzero(plan["length"] == length)
        own = own[np.argsort(plan["rank"][own])]
        for rank in range(n):
            k = own[np.searchsorted(plan["rank"][own], rank, side="right") - 1]
            nth = rank - plan["rank"][k]
            bins[int(plan["bin"][k] + nth // plan["each"][k])].append((int(plan["offset"][k] + nth % plan["each"][k] * length), length))
    return {k: sorted(v) for k, v in bins.items()}


def plain_best_fit(lengths, caps):
    """Numbers of bins by the rule, piece by piece: best fit under every capacity, pieces by descending length."""
    top, bins = caps.full(), []
    weight = np.array(caps.weights) / top
    for length in sorted(lengths, reverse=True):
        need = np.minimum([length, 1, length * length], top)
        best = None
        for i, room in enumerate(bins):
            if (room >= need).all():
                score = (((room - need) * weight) ** 2).sum() if caps.rule == "norm" else -(room / top * (need / top) * caps.weights).sum()
                if best is None or (score, room[0], room[1]) < best[0]:
                    best = (score, room[0], room[1]), i
        if best is None:
            bins.append(np.array(top) - need)
        else:
            bins[best[1]] = bins[best[1]] - need
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("pieces, attention", [(5, None), (None, 1500), (5, 1500), (None, None)])
def test_plan_respects_every_capacity(rule, pieces, attention):
    rng = np.random.default_rng(3)
    lengths = np.minimum(64, rng.geometric(0.05, 1500))
    caps = packing.Capacities(tokens=64, pieces=pieces, attention=attention, rule=rule)
    bins = planned(lengths, caps)
    assert sum(map(len, bins.values())) == len(lengths)
    fits = lambda own: len(own) <= (pieces or 64) and (len(own) == 1 or sum(n * n for _, n in own) <= (attention or 4096))
    for own in bins.values():
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64
        assert fits(own)
    # the capacities bind: without them sequences break them, and fewer are made
    free = planned(lengths, packing.Capacities(tokens=64, rule=rule))
    assert (pieces is None and attention is None) or (not all(map(fits, free.values())) and len(free) < len(bins))
    # as many bins as the rule makes one piece at a time, which does not take equal bins in groups
    assert len(bins) <= plain_best_fit(lengths, caps) * 1.02 + 1
    with pytest.raises(ValueError):
        packing.plan_bins({65: 1}, caps)


def test_pipeline_capacities_bind(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.best_fit_packing(spark, docs, SF).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length") ** 2).alias("cost"), F.sum("length").alias("tokens")).collect()
    top = corpus_pipeline.SEQUENCES
    assert all(r["tokens"] <= top.tokens and r["n"] <= top.pieces and (r["n"] == 1 or r["cost"] <= top.attention) for r in rows)
    free = packing.op7_best_fit_packing(spark, SF).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length") ** 2).alias("cost")).collect()
    assert any(r["n"] > top.pieces for r in free) and any(r["n"] > 1 and r["cost"] > top.attention for r in free)


def test_packing_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op7_best_fit_packing(spark, str(tmp_path)).collect() == []
    clashing = documents(spark, [(None, None, None, None, None), (1, "a b", "x", "y", 1)]).withColumns({c: F.lit("x") for c in ("part", "length", "rank", "offset", "n", "before")})
    assert sorted((r["doc_id"], r["length"]) for r in packing.pack_documents(clashing).collect() if r["doc_id"]) == [(1, 3)]


def test_packing_is_tight(spark):
    got = packing.op7_best_fit_packing(spark, SF).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("t"), F.sum(F.when(F.col("length") == 1024, 0).otherwise(F.col("length"))).alias("r")).first()
    assert got["n"] <= -(-got["t"] // 1024) * 1.02 + 1


def test_token_files_round_trip(spark):
    docs = documents(spark)
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    tokenfiles.write_store(docs, path, shards=5, block_bytes=2000)
    got = tokenfiles.read_store(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for g, r in zip(got, rows):
        ids = _u4([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        assert (g["start"], g["n_tokens"], g["ids_crc32"], bytes(g["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert tokenfiles.read_document(spark, path, 9) == _ids("word_bpe_49k.json", next(r["text"] for r in rows if r["doc_id"] == 9), 1)
    assert tokenfiles.read_document(spark, path, 99999) is None


def test_token_files_of_awkward_tables(spark, tmp_path):
    """The query over nulls in every column, repeated rows and clashing names; wide ids are refused, not cut."""
    docs = documents(spark).unionByName(documents(spark, [(None, "no id", None, None, None), (None, None, None, None, None)]))
    docs.withColumns({c: F.lit("x") for c in ("shard", "block", "ends", "payload", "start", "n_tokens")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = tokenfiles.op6_token_id_files(spark, str(tmp_path)).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["n_tokens"] for r in got] == [len(_ids("word_bpe_49k.json", r["text"], 1)) for r in rows]
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tokenfiles.op6_token_id_files(spark, f"{tmp_path}/none").collect() == []
    assert tokenfiles._serialized(_u4([65535]), 2) == b"\xff\xff"
    with pytest.raises(ValueError):
        tokenfiles._serialized(_u4([3, 65536]), 2)


def test_steps_need_a_shared_folder_and_can_be_discarded(spark):
    from types import SimpleNamespace

    from corpusflow import steps

    bare = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=dict), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        steps.shared_dir(bare)
    step = steps.materialize(spark.range(3), "step")
    assert step.count() == 3
    steps.discard_steps(spark)
    assert not __import__("os").path.exists(steps.steps_dir(spark).removeprefix("file://"))


def test_token_files_query(spark):
    got = {r["doc_id"]: r for r in tokenfiles.op6_token_id_files(spark, SF).collect()}
    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = _u4([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_pieces_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = {(r["doc_id"], r["text"]): r["text"] or "" for r in docs.collect()}
        got = sentpiece.encode_pieces(docs, columns=("ids", "starts", "ends", "decoded", "ids_sha256", "decoded_sha256", "n_tokens", "spanned_bytes"))
        by_ids = {(r["doc_id"], r["ids_sha256"]): r for r in got.collect()}
        for (doc_id, _), text in rows.items():
            ids = library.encode(text, add_bos=True, add_eos=True)
            r = by_ids[doc_id, hashlib.sha256(_u4(ids)).hexdigest()]
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
            assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
            raw = text.encode()
            assert r["spanned_bytes"] == len(raw)
            for i, lo, hi in list(zip(ids, r["starts"], r["ends"]))[:2000]:
                if not library.is_control(i) and not library.is_byte(i) and not library.is_unknown(i):
                    assert raw[lo:hi].decode().replace(" ", "▁") in (library.id_to_piece(i), library.id_to_piece(i)[1:])
        back = sentpiece.decode_pieces(got.select("doc_id", "ids"))
        assert back.exceptAll(got.select("doc_id", "decoded")).isEmpty()


def test_every_text_of_the_query_is_normalised(spark, tmp_path):
    """Spans come from the alignment of the whole normalised text; odd rows and clashing names included."""
    codec, seen = sentpiece.piece_codec("piece_bpe_32k.model"), []
    whole = codec.normalizer
    codec.normalizer = lambda text: seen.append(text) or whole(text)
    texts = ["a b", "", "▁x  y", "é\n\n ü", "word " * 100_000]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), "<u4")
        lo, hi = codec.spans(text, ids)
        assert int((hi - lo).sum()) == len(text.encode())
    codec.normalizer = whole
    assert seen == [t for t in texts if t]
    docs = documents(spark).unionByName(documents(spark, [(None, None, None, None, None)])).withColumns({c: F.lit("x") for c in ("ids", "starts", "n_tokens")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sentpiece.op2_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["spanned_bytes"])) for r in got) == sorted(str((r["doc_id"], len((r["text"] or "").encode()))) for r in docs.collect())


def test_compiled_character_map():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(sentpiece.proto_fields(normalizer.serialized_model_proto()))[3]
    own = sentpiece.Normalizer(spec)
    rng = np.random.default_rng(8)
    letters = list("aB é ﬁ①ｶﾞ½  Ａ\u0301\t\n\u3000x")
    made_up = ["".join(rng.choice(letters, 30)) for _ in range(200)]
    for text in [*made_up, "ＫＡＤＯＫＡＷＡ   ABC ", "ﬁne ①②  ½ ｶﾞｷﾞ", "", "   ", "plain", "a b​c\td", "Å é ñ"]:
        made, origin = own(text)
        assert made.decode() == normalizer.normalize(text), text
        assert len(origin) == len(made) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())
