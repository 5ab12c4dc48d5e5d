"""Commits and compactions when writers die or come together."""

from collections import Counter

import pytest

from strandlab.llm import tokencounts as T


@pytest.fixture
def rollup(spark, tmp_path):
    return T.Rollup(spark, f"file://{tmp_path}/r")


def rows(spark, tokens, sign=1):
    return spark.createDataFrame([("s", "en", "v", tokens, sign)], "source string, lang string, tokenizer string, tokens long, sign int")


def tokens(roll):
    return [r["n_tokens"] for r in roll.totals().collect()]


def test_an_empty_marker_loses_no_batch(spark, rollup, tmp_path):
    (tmp_path / "r" / "batch=1").touch()
    assert not rollup.has("1") and tokens(rollup) == []
    assert rollup.commit("1", rows(spark, 5)) and rollup.has("1") and tokens(rollup) == [5]
    assert not rollup.commit("1", rows(spark, 5)) and tokens(rollup) == [5]
    (tmp_path / "r" / "batch=1").write_text("data-")  # half a name
    assert rollup.has("1") and tokens(rollup) == [5]
    (tmp_path / "r" / "batch=2").touch()
    (tmp_path / "r" / "batch=2!1").touch()
    assert rollup.commit("2", rows(spark, 7)) and tokens(rollup) == [12]
    rollup.compact()
    assert tokens(rollup) == [12] and not rollup.commit("2", rows(spark, 7)) and not rollup.commit("1", rows(spark, 5))


def test_a_slow_writer_after_a_takeover_counts_once(spark, rollup, tmp_path):
    (tmp_path / "r" / "batch=1").touch()
    assert rollup.commit("1", rows(spark, 5))
    folder = "data-" + "0" * 32
    T.signed(rows(spark, 5), 1).selectExpr("source", "lang", "tokenizer", "1L AS n_docs", "tokens AS n_tokens").write.parquet(f"file://{tmp_path}/r/{folder}")
    (tmp_path / "r" / "batch=1").write_text(folder)
    assert tokens(rollup) == [5]
    rollup.compact()
    rollup.commit("2", rows(spark, 1))
    rollup.compact()
    assert tokens(rollup) == [6] and not list((tmp_path / "r").glob("batch=1*"))


def test_an_empty_snapshot_marker_is_passed_over(spark, rollup, tmp_path):
    rollup.commit("1", rows(spark, 5))
    (tmp_path / "r" / f"snapshot={1:012d}").touch()
    assert tokens(rollup) == [5] and rollup.compact() and tokens(rollup) == [5]
    rollup.commit("2", rows(spark, 2))
    assert rollup.compact() and rollup.compact() is False and tokens(rollup) == [7]


def test_old_files_go_and_readers_keep_theirs(spark, tmp_path):
    roll = T.Rollup(spark, f"file://{tmp_path}/r", compact_after=3)
    early = None
    for k in range(12):
        assert roll.commit(f"b{k}", rows(spark, 1))
        early = roll.totals() if k == 4 else early
        if k == 5:
            assert [r["n_tokens"] for r in early.collect()] == [5]
    assert tokens(roll) == [12] and [roll.commit(f"b{k}", rows(spark, 1)) for k in range(12)] == [False] * 12
    kinds = Counter(p.name.split("=")[0].split("-")[0] for p in (tmp_path / "r").iterdir())
    assert kinds["snapshot"] == 2 and kinds["batch"] <= 6 and kinds["data"] <= 8


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    one, two = (T.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    one.commit("1", rows(spark, 5))
    mark = T.Rollup._mark

    def late(self, name, folder):
        if self is two and name.startswith("snapshot"):
            one.commit("2", rows(spark, 2))
            assert one.compact()
        return mark(self, name, folder)

    monkeypatch.setattr(T.Rollup, "_mark", late)
    assert two.compact() is False and tokens(two) == [7] and two.has("1") and two.has("2")
