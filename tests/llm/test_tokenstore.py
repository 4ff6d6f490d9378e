import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelith.llm import common, packing, tokenstore

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


SHARED = " ".join(f"w{k * 7919 % 10_007}" for k in range(1500))
ROWS = [(5, SHARED, "x"), (2, "alpha beta " * 900, "y"), (9, None, "z"), (3, "", "z"), (1, "lead in " + SHARED, "x"), (None, "no id here", "q"), (7, "alpha", None), (7, "alpha", None)]
SCHEMA = "doc_id long, text string, key string"


@pytest.fixture(scope="module")
def stored(spark):
    path = common.new_path(spark, "store")
    tokenstore.write_store(spark.createDataFrame(ROWS, SCHEMA), path, PATH)
    return path


def test_round_trip(spark, stored):
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in tokenstore.read_documents(spark, stored).collect())
    assert sorted((d is not None, d, ids) for _, d, ids in got) == sorted((d is not None, d, [*ids_of(t), 2]) for d, t, _ in ROWS)
    order = [d for _, d, _ in got]
    assert order == [None, 1, 2, 3, 5, 7, 7, 9]
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)


def test_checks_agree_with_the_streams(spark, stored):
    got = {(r["start"], r["doc_id"]): (r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_checks(spark, stored).collect()}
    whole = {(r["start"], r["doc_id"]): (len(r["ids"]), crc(r["ids"])) for r in tokenstore.read_documents(spark, stored).collect()}
    assert got == whole


def test_equal_passages_are_stored_once(spark, stored):
    ids = sum(r["n_ids"] for r in tokenstore.recipes(spark, stored).collect())
    held = sum(len(r["payload"]) // 2 for r in tokenstore.chunks(spark, stored).collect())
    assert held < 0.7 * ids


def test_crcs_of_pieces_join_to_that_of_the_whole():
    rng = np.random.default_rng(3)
    for sizes in ([0, 1, 5], [700, 0, 70_001, 3], [1], [9] * 50):
        parts = [rng.bytes(n) for n in sizes]
        after = np.cumsum(sizes[::-1])[::-1] - sizes
        got = np.bitwise_xor.reduce(tokenstore.crc_shift(np.array([zlib.crc32(p) for p in parts]), after))
        assert int(got) == zlib.crc32(b"".join(parts))


def test_merkle_root_depends_on_order():
    assert tokenstore.merkle([b"a", b"b", b"c"]) != tokenstore.merkle([b"a", b"c", b"b"])


@pytest.mark.parametrize("how", ["flipped payload", "lost chunk", "other digests"])
def test_damaged_data_are_found(spark, tmp_path, how):
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(k, f"text number {k} " * 90, "") for k in range(20)], SCHEMA), path, PATH)
    if how == "other digests":
        table, hurt = "recipes", "if(doc_id = 3, concat(digests, substring(digests, 1, 16)), digests) AS digests"
        bad = spark.read.parquet(f"{path}/{table}").selectExpr("doc_id", "part", "local_start", "n_ids", "root", hurt)
    else:
        table, data = "data", spark.read.schema(tokenstore.DATA_SCHEMA).parquet(f"{path}/data")
        one = data.where("kind = 0").agg({"key": "max"}).first()[0].hex()
        hurt = f"if(kind = 0 and hex(key) = upper('{one}'), concat(payload, X'0101'), payload) AS payload"
        bad = data.selectExpr("kind", "key", hurt, "doc_id", "n_ids", "digests") if how == "flipped payload" else data.where(f"kind = 1 or hex(key) <> upper('{one}')")
    writer = bad.write if table == "recipes" else bad.write.partitionBy("kind")
    writer.parquet(f"{path}/hurt")
    (tmp_path / "store" / table).rename(tmp_path / "store" / "before")
    (tmp_path / "store" / "hurt").rename(tmp_path / "store" / table)
    for read in (tokenstore.read_checks, tokenstore.read_documents):
        with pytest.raises(Exception, match="does not match its|missing"):
            read(spark, path).collect()


def test_documents_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        path = common.new_path(spark, "store")
        tokenstore.write_store(spark.createDataFrame([(k, f"{k} lorem {k * k} " * (400 * (k % 4) + 1), "") for k in range(30)], SCHEMA), path, PATH)
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenstore.read_checks(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (len(w := [*ids_of(f"{k} lorem {k * k} " * (400 * (k % 4) + 1)), 2]), crc(w)) for k in range(30)}


def test_borders_cover_every_id():
    ids = np.random.default_rng(1).integers(0, 49_000, 20_000).astype("<u2")
    ends = tokenstore.borders(len(ids), tokenstore.candidates(ids).tolist())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MOST and sizes[:-1].min() >= tokenstore.LEAST


def test_empty_store(spark):
    path = common.new_path(spark, "store")
    tokenstore.write_store(spark.createDataFrame([], SCHEMA), path, PATH)
    assert tokenstore.read_checks(spark, path).count() == 0


def test_packing(spark):
    rows = [*ROWS, *[(100 + k, "word " * (37 * k % 900), "s") for k in range(120)]]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, capacity=256).collect()
    want = []
    for d, t, _ in rows:
        ids = [*ids_of(t), 0]
        want += [(d, k, a, len(ids[a : a + 256]), crc(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(w[3] for w in want) // 256) * 1.1 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_best_fit_takes_the_tightest_bin():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 4, 8, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 9)]
    # a third open bin closes the fullest
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n)[0] for n in (6, 7, 8, 3, 4)] == [0, 1, 2, 0, 3]


@pytest.mark.parametrize("table", ["recipes", "manifest"])
def test_lost_rows_are_found(spark, tmp_path, table):
    path = f"{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([(k, f"text number {k}", "") for k in range(40)], SCHEMA), path, PATH)
    whole = spark.read.parquet(f"{path}/{table}")
    lost = whole.where("doc_id <> 7" if table == "recipes" else "part > 0")
    assert 0 < lost.count() < whole.count()
    lost.write.parquet(f"{path}/less")
    (tmp_path / "store" / table).rename(tmp_path / "store" / "before")
    (tmp_path / "store" / "less").rename(tmp_path / "store" / table)
    for read in (tokenstore.read_checks, tokenstore.read_documents):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, path).collect()


def test_few_files_get_as_many_packers_as_they_need(spark):
    rows = [(k, "word " * (5 + k % 7), "") for k in range(60)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), PATH, capacity=64, shard_pieces=20).collect()
    assert len(got) == 60 and len({r["sequence_id"] >> 33 for r in got}) == 3


def test_bins_close_when_all_are_open():
    """With few open bins the fullest closes; no bin overflows and no piece is lost."""
    r = np.random.default_rng(4)
    fit, used = packing.BestFit(100, open_bins=8), {}
    for n in r.integers(1, 90, 5000).tolist():
        b, at = fit.place(n)
        assert at == used.get(b, 0) and at + n <= 100 and fit.open <= 8
        used[b] = at + n
    assert len(used) < 1.15 * sum(used.values()) / 100


def test_close_deletes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: str(tmp_path))
    monkeypatch.setattr(common, "_made", {})
    common.materialize(spark.range(3), "some")
    assert list((tmp_path / "panelith").iterdir())
    common.close(spark)
    assert not list((tmp_path / "panelith").iterdir())
