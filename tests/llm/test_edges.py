"""Every query and stage on nulls, empty and very long texts, ties and repeated rows, clashing columns, and no rows."""

import hashlib
import zlib
from collections import Counter

import pytest

from edge_rows import rows, vectors
from strandlab.llm.queries import QUERIES

IDS = Counter(r[0] for r in rows())
DOCS = sum(IDS.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_cases(spark, edge_dir, name):
    got = QUERIES[name](spark, edge_dir).collect()
    if name.startswith("op7"):
        assert sum(r["n_docs"] for r in got) == DOCS - 1  # document 2 is labelled low quality
    elif name.startswith("op11"):
        kept = [v for v in vectors() if v[1] is not None and len(v[1]) == 64 and all(x is not None and abs(x) < float("inf") for x in v[1])]
        assert Counter(r["vec_id"] for r in got) == Counter(v[0] for v in kept)
    elif name.startswith("op1_"):
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == IDS
    else:
        assert Counter(r["doc_id"] for r in got) == IDS
    check = globals().get("check_" + name.split("_")[0])
    if check:
        check(got)


def one(got, i):
    return next(r for r in got if r["doc_id"] == i)


def check_op1(got):
    assert all(one(got, i)["length"] == 1 for i in (6, 7)) and sum(r["length"] for r in got if r["doc_id"] == 9) > 60_000


def check_op2(got):
    assert one(got, 7)["text"] is None and one(got, 7)["n_lines"] == 0 and one(got, 6)["n_removed"] == 0
    assert one(got, 3)["removed"] == [1] and one(got, 5)["text"] == "" and one(got, 15)["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] in (None, 10))


def check_op3(got):
    assert one(got, 7)["size"] == 0 == one(got, 7)["taken"] and one(got, 9)["size"] == 60_000
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def check_op4(got):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert one(got, 6)["score"] == one(got, 7)["score"]
    assert one(got, None)["held_out"] is False


check_op5 = check_op4


def check_op6(got):
    assert [one(got, i)["n_words"] for i in (6, 7, 8, 9, 10, 13)] == [0, 0, 0, 60_000, 2, 1]
    assert one(got, 7)["base_failed"] and not one(got, 7)["kept"] and one(got, 15)["n_dup_lines"] == 1999


def check_op8(got):
    assert one(got, 6)["fingerprint"] == one(got, 7)["fingerprint"] and one(got, 13)["n_chars"] == 300_000
    assert one(got, 6)["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    first = sorted(r["near_next"] for r in got if r["doc_id"] == 10)
    assert first[1] == 1.0  # the first of two equal rows is followed by the second


def check_op9(got):
    assert one(got, 5)["class_id"] == 1 and one(got, 7)["class_id"] == 6 and one(got, 10)["n_copies"] == 2
    assert one(got, None)["class_id"] is None and one(got, 4)["class_id"] == 1 and one(got, 4)["n_links"] == 1


def check_op10(got):
    assert one(got, 3)["base_labels"] == "mit" and one(got, 12)["labels"] == "apache" and one(got, 7)["n_words"] == 0
    assert one(got, 6)["first_word"] is None and one(got, 3)["score"] == 1.0


def check_op11(got):
    assert len({r["cluster"] for r in got if r["vec_id"] in (50, 51)}) == 1 and len({r["cluster"] for r in got if r["vec_id"] in (53, 54)}) == 1
    assert all(0 <= r["cluster"] < 8 for r in got)


def check_op12(got):
    assert len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 4  # null, de, en, tr
    assert one(got, 14)["leaf"] == one(got, 14)["subroot"] and len({r["leaf"] for r in got if r["doc_id"] == 10}) == 1
    assert all(r["verified"] for r in got if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3)


def check_op13(got):
    assert [(one(got, i)["lang_pred"], one(got, i)["score"]) for i in (6, 7, 8)] == [("und", 0.0)] * 3
    assert all(r["lang_pred"] in ("en", "de", "tr") and 0 <= r["score"] <= 1 for r in got if r["doc_id"] in (1, 3, 9, 13))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_edge_cases(spark, edge_dir, empty_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = {}
    for name, stage in P.STAGES[:-1]:
        df = stage(spark, docs, edge_dir)
        assert df.schema.names == docs.schema.names, name
        assert [f.dataType for f in df.schema] == [f.dataType for f in docs.schema], name
        out[name] = Counter(map(tuple, df.collect()))
    have = Counter(map(tuple, docs.collect()))
    assert out["quality_rules"] <= have and out["near_duplicates"] <= have
    assert Counter(k[0] for k in out["line_dedup"]) <= IDS and {9, 13, None} <= {k[0] for k in out["line_dedup"]}
    kept = Counter(k[0] for k in out["near_duplicates"])
    assert kept[1] == kept[10] == 1 and not {4, 5, 7} & set(kept) and kept[None] == 2
    assert all(n <= 2 * have[k] for k, n in out["mix_sources"].items())
    assert P.run(spark, edge_dir).count() > 0
    assert P.run(spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_very_long_text(spark, tmp_path_factory, name):
    """One text of more than 10 MB beside short ones."""
    d = str(tmp_path_factory.mktemp("long"))
    big = "\n".join(" ".join(f"w{(i * 7919 + k * 31) % 9973}" for k in range(40)) for i in range(50_000))
    assert len(big) > 10_000_000
    spark.createDataFrame([(1, "a few words", "en", "s", 11), (2, big, "en", "s", len(big)), (3, "more", "en", "t", 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    if name.startswith("op11"):
        return  # reads no text
    got = QUERIES[name](spark, d).collect()
    if not name.startswith("op7"):
        assert {r["doc_id"] for r in got} == {1, 2, 3}
