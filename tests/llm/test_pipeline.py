import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelith.llm import common, mixing, toxicity
from panelith.llm.queries import word_tokenizer

from .test_pii import slow
from .test_shingles import groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdfghk" for b in ("ar", "et", "on", "um") for c in ("", "o", "is")]
    texts, labels = [], []
    for k in range(300):
        t = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        if k % 5 == 0:
            for _ in range(4):
                t[rnd.randrange(len(t))] = rnd.choice(["grobnik", "smurdak"])
        if k % 7 == 0:
            t.insert(2, f"mail{k}@host.org")
        texts.append(" ".join(t))
        labels.append((k, int(k % 5 == 0)))
    texts += texts[1:30] + ["", "", None, "one"]
    rows = [(k, t, "en", f"s{k % 4}" if k % 11 else None, len(t or ""), 1) for k, t in enumerate(texts)]
    rows += [(None, "no id at all here", "en", "s1", 17, 1), (3, texts[3], "en", "s3", len(texts[3]), 1)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = common.materialize(stage(spark, docs, folder), f"test-{name}")
        after = [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns
        key = lambda r: str(sorted(r.items(), key=str))
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert sorted(map(key, after)) == sorted(key(r) for r in before if model.score(r["text"]) < 0.5)
            assert not any("grobnik" in (r["text"] or "") for r in after) and len(after) > 200
        elif name == "near_duplicates":
            comp = groups([r["text"] for r in before])
            least = {}
            for n, r in enumerate(before):
                least[comp[n]] = min(least.get(comp[n], 1 << 62), 1 << 61 if r["doc_id"] is None else r["doc_id"])
            assert sorted(1 << 61 if r["doc_id"] is None else r["doc_id"] for r in after) == sorted(least.values())
        elif name == "personal_data":
            want = []
            for r in before:
                t, out_text, last = r["text"], "", 0
                for s, k, e in slow(t or ""):
                    out_text += t[last:s] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]"
                    last = e
                new = None if t is None else out_text + t[last:]
                want.append(r | {"text": new, "n_chars": None if new is None else len(new)})
            assert sorted(map(key, after)) == sorted(map(key, want))
        elif name == "mixture":
            con = duckdb.connect()
            con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
            con.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in before])
            taken = {i: t // n for i, n, _, _, t in con.sql(mixing.ORACLE).fetchall() if n}
            got = Counter(r["doc_id"] for r in after if r["text"])
            assert got == Counter({i: n for i, n in taken.items() if n})
        else:
            whole = Tokenizer.from_file(word_tokenizer())
            want = []
            for r in before:
                ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
                want += [(str(r["doc_id"]), k, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
            assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in after) == sorted(want)
        docs = out


def test_run_and_empty_input(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
