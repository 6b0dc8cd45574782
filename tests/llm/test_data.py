"""Mixing, packing, archives, the pipeline and the registry."""

import io
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logspark.llm.common import connected_components, ranked
from logspark.llm.common import file_order
from logspark.llm.mixing import TARGETS, mix, mixed, period_shares, plan_period
from logspark.llm.packing import Encoder, best_fit, cut, pack, pack_histogram
from logspark.llm.warc import DamagedRecord, encode_record, read_archives, read_records, warc_round_trip, write_archives

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_connected_components(sp):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(sp.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_ranks_are_gapless_per_key(sp):
    df = sp.createDataFrame([(None if i % 3 else "k", i) for i in range(500)], "k string, i long")
    got = ranked(df, ["k"], ["i"], rows=40).collect()
    for k in (None, "k"):
        own = [r["_rank"] for r in got if r["k"] == k]
        assert sorted(own) == list(range(len(own)))


def test_period_meets_all_windows():
    for weights in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.7, "b": 0.2, "c": 0.1}, {str(i): i + 1.0 for i in range(17)}):
        shares = period_shares(weights, 200)
        assert sum(shares.values()) == 200
        plan = plan_period(shares, 200)
        assert sorted(x for s in plan.values() for x in s) == list(range(200))
        for s, slots in plan.items():
            assert all(i * 200 // shares[s] <= x < -(-(i + 1) * 200 // shares[s]) for i, x in enumerate(slots))


def test_mix_deviates_less_than_a_block(sp):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaabbc"), "x" * rng.randint(0, 60)) for i in range(900)] + [(5, "a", None), (5, "a", None), (None, None, "null source")]
    df = sp.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_slot", F.lit("clash"))
    got = mix(df, {"a": 0.5, "b": 0.3, "c": 0.2}, block_chars=300, period=100).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["source"]) for r in got) == Counter((i, s) for i, s, _ in rows)
    slots = defaultdict(set)
    for r in got:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
        slots[r["mix_slot"]].add((r["row"]["source"], r["mix_block"]))
    assert all(len(b) == 1 for b in slots.values())  # a slot has one block
    order = [r["doc_id"] for r in mixed(df, weights={"a": 0.5, "b": 0.3, "c": 0.2}, block_chars=300, period=100).collect()]
    assert len(order) == len(rows)
    assert mix(df.limit(0)).collect() == []


def test_mixed_moves_documents_once(sp, tmp_path, capsys):
    rows = [(i, "ab"[i % 2], "x" * (i % 90)) for i in range(400)]
    sp.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/docs")
    out = mixed(sp.read.parquet(f"{tmp_path}/docs"), weights={"a": 0.7, "b": 0.3}, block_chars=300, period=100)
    capsys.readouterr()
    out.explain("formatted")
    moves = re.findall(r"\) Exchange\n(?:Input|Arguments).*", capsys.readouterr().out)
    assert sum("row#" in m for m in moves) == 1


def test_mixed_splits_copies_over_blocks(sp, monkeypatch):
    from logspark.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_CHARS", 2_000)  # several buckets of a source, one with far more copies
    rng = random.Random(8)
    rows = [(i, rng.choice("aab"), "x" * rng.randint(0, 60), "en") for i in range(300)]
    rows += [(1_000, "a", "copy " * 10, rng.choice(["en", None]))] * 90 + [(None, None, None, "de")] * 700 + [(1_001, "b", "", None)] * 40
    df = sp.createDataFrame(rows, "doc_id long, source string, text string, lang string").repartition(5)
    how = {"weights": {"a": 0.5, "b": 0.3}, "block_chars": 300, "period": 100}
    places = mix(df, **how).orderBy("mix_slot", "mix_offset").collect()
    plain = [r["row"] for r in places]
    assert all(len({r["mix_slot"] for r in places if r["row"]["doc_id"] == i}) > 1 for i in (1_000, None))  # copies of one text lie in several slots
    got = mixed(df, **how).collect()
    assert [r[:3] for r in got] == [r[:3] for r in plain] and Counter(got) == Counter(plain)


def test_encoder_equals_the_tokeniser():
    encode = Encoder(PATH)
    rng = random.Random(8)
    bits = ["the", "it's", "É ", " ", "\n", "  ", "\t", "12", "$$$", "word.", "<|endoftext|>", " ", " ", "\x1c", "漢字", "\U0001f600", "x", ","]
    texts = ["", " ", "\n", "a", "a b\nc"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    for t in texts:
        assert encode(t) == np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_encoder_asks_the_tokeniser_once_for_new_words():
    encode, calls = Encoder(PATH), []
    library = encode.tokenizer

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(library, name)

    encode.tokenizer = Counted()
    text = "one two\nthree " * 3 + "four"
    assert encode(text) == encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(calls) == 3 and len(encode.seen) == 4
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_plans_hold_every_piece_once():
    rng = random.Random(9)
    for n, room in ((0, 50), (1, 50), (40, 50), (3000, 50), (3000, 64)):
        hist = Counter(rng.randint(1, room) for _ in range(n))
        plan = pack_histogram(dict(hist), room, rounds=60)
        got = Counter()
        for config, times in plan:
            assert sum(config) <= room
            for x in config:
                got[x] += times
        assert got == hist
        bound = -(-sum(a * b for a, b in hist.items()) // room)
        assert sum(t for _, t in plan) <= max(bound * 1.02 + 1, sum(t for _, t in best_fit(dict(hist), room)) * 1.01 + 1)


def test_pack(sp, texts):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(("some", "Words", "hier", "x1")) for _ in range(rng.choice((1, 5, 40, 90, 300))))) for i in range(120)] + [(500, None), (501, ""), (7, "again"), (None, "no id")]
    got = pack(texts(rows, extra=True), PATH, length=64, rounds=60, keep_ids=True).toPandas()
    tok = Encoder(PATH)
    for doc, text in rows:
        if doc in (7, None):
            continue
        ids = [*np.frombuffer(tok(text or ""), "<u4").tolist(), 2]
        own = got[got.doc_id == doc].sort_values("piece")
        assert [x for p in own.ids for x in p] == ids and (own.length.iloc[1:] == 64).all() and (own.length <= 64).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1].tolist()] and seq.length.sum() <= 64
    assert got.sequence_id.nunique() <= sum(n for _, n in best_fit(dict(Counter(got.length.tolist())), 64))
    assert pack(texts([]), PATH, length=64, rounds=5).collect() == []


def test_archives_round_trip(sp, tmp_path):
    big = "<p>é" + "x" * 500
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "z" * 200), (1, "http://b", big)]
    pages = sp.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("to", F.lit(1))
    got = warc_round_trip(pages, f"file://{tmp_path}/w").collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert len(got) == len(rows) and kinds[1] == ("response", None, 505) and kinds[2] == ("revisit", 1, 505) and kinds[3] == ("revisit", 1, 505)
    assert kinds[4][0] == kinds[5][0] == kinds[6][0] == kinds[7][0] == "response" and kinds[9] == ("revisit", 8, 100) and kinds[None][0] == "response"
    full = read_archives(write_archives(pages, f"file://{tmp_path}/v"), with_payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in full if r["record_type"] == "response" and r["page_id"]} == {1: big, 4: "short", 5: "short", 6: "", 7: "", 8: "y" * 100}
    assert warc_round_trip(pages.limit(0), f"file://{tmp_path}/e").collect() == []


def test_reader_frames_members_and_rejects_damage():
    import hashlib

    def member(p, digest=None):
        return encode_record("response", "u", "<urn:x>", digest or hashlib.sha256(p).hexdigest(), p, {})

    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 3_000]
    data = b"".join(map(member, payloads))
    for chunk in (1 << 16, 7):
        assert [r.payload for r in read_records(io.BytesIO(data), chunk)] == payloads
    with pytest.raises(DamagedRecord):
        list(read_records(io.BytesIO(data[:-4])))
    with pytest.raises(DamagedRecord):
        list(read_records(io.BytesIO(member(b"abc", "0" * 64))))


def test_pipeline_stages(sp):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = sp.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    out = corpus_pipeline.run(sp, d).toPandas()
    kept = set(out.doc_id)
    assert 0 < len(kept) < docs.count()
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(sp, docs, d).columns == docs.columns
        assert stage(sp, docs.limit(0), d).count() == 0


def test_sequences_follow_the_order_of_the_mix(sp, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = sp.read.parquet(f"{d}/documents.parquet")
    plain, mixed_up = f"{tmp_path}/plain", f"{tmp_path}/mixed"
    docs.repartition(3).write.parquet(plain)
    corpus_pipeline.source_mix(sp, docs, d).write.parquet(mixed_up)

    def first_places(path):
        rows = sp.read.parquet(path)
        place = {r["doc_id"]: r["p"] for r in rows.select("doc_id", file_order(rows).alias("p")).collect()}
        out = corpus_pipeline.packing(sp, rows, d).toPandas()
        firsts = out.assign(p=out.doc_id.map(place)).groupby("sequence_id").p.min()
        assert firsts.is_monotonic_increasing and firsts.index.tolist() == list(range(len(firsts)))
        return out.sort_values(["doc_id", "piece"])

    a, b = first_places(plain), first_places(mixed_up)
    assert a[["doc_id", "piece", "start", "length", "ids_crc32", "offset"]].equals(b.reset_index(drop=True).set_index(a.index)[["doc_id", "piece", "start", "length", "ids_crc32", "offset"]])
    assert a.sequence_id.tolist() != b.sequence_id.tolist()  # without the mix the numbers differ


def test_mix_meets_unequal_targets_over_the_table(sp):
    rows = mix(sp.read.parquet("/root/testdata/sf0.01/documents.parquet"), TARGETS, block_chars=2_000, period=100, carry=["doc_id", "source"]).toPandas()
    first = rows[rows.mix_phase == 0]
    blocks = first.groupby("mix_source").mix_block.max() + 1  # some blocks lie within one long document
    period = TARGETS | {s: min(TARGETS.values()) for s in blocks.index if s not in TARGETS}
    total = sum(period[s] for s in blocks.index)
    slots = first.mix_slot.max() + 1
    for s in blocks.index:
        assert abs(blocks[s] - slots * period[s] / total) <= 0.05 * slots + 1
    assert blocks["src0"] > 3 * blocks["src4"]


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
