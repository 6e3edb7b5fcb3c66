"""Settings, numbered lines over many splits, reports and counts on a stream."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import lookup
from reviewlake.operators.dataset import count_ranks, group_split
from reviewlake.operators.review import review
from reviewlake.sources import files, settings
from reviewlake.streaming import review_stream
from tests.test_queries import SCHEMA, finding

NESTED = """
# how to train
model:
  name: "base # one"   # the comment
  quantization: {}
  target_modules: [q_proj, "v, proj", 'it''s']
training:
  epochs: 3
  learning_rate: 2.0e-4
  schedule:
    kind: cosine
    warmup: .1
  eval: false
  notes:
files:
- path: a.jsonl
  weight: 1
-
  path: 'b: c.jsonl'
empty: ~
url: http://host:80/x
"""


def test_nested_settings():
    assert settings.parse(NESTED) == {
        "model": {"name": "base # one", "quantization": {}, "target_modules": ["q_proj", "v, proj", "it's"]},
        "training": {"epochs": 3, "learning_rate": 2.0e-4, "schedule": {"kind": "cosine", "warmup": 0.1}, "eval": False, "notes": None},
        "files": [{"path": "a.jsonl", "weight": 1}, {"path": "b: c.jsonl"}], "empty": None, "url": "http://host:80/x",
    }
    assert settings.parse("") == {} and settings.parse("a:\n- 1\n- two") == {"a": [1, "two"]}


@pytest.mark.parametrize("text, line", [("a: 1\na: 2", 2), ("a:\n\tb: 1", 2), ("a: 1\n  b: 2", 2), ("just words", 1), ("a: |\n  x", 1), ("a:\n    b: 1\n  c: 2", 3), ("- 1\na: 2", 2)])
def test_wrong_settings_name_their_line(text, line):
    with pytest.raises(settings.SettingsError, match=f"line {line}:"):
        settings.parse(text)


def test_settings_over_nested_defaults(spark, tmp_path):
    defaults = {"model": {"name": "x", "rank": 8}, "files": [], "extra": {}}
    (tmp_path / "a.yaml").write_text("model:\n  rank: 16\nextra:\n  any: 1\n")
    assert files.read_config(spark, str(tmp_path / "a.yaml"), defaults) == {"model": {"name": "x", "rank": 16}, "files": [], "extra": {"any": 1}}
    for wrong, told in (("model:\n  size: 1", "model.size"), ("model: 3", "section"), ("files:\n  a: 1", "no section"), ("other: 1", "other")):
        (tmp_path / "b.yaml").write_text(wrong)
        with pytest.raises(ValueError, match=told):
            files.read_config(spark, str(tmp_path / "b.yaml"), defaults)
    assert files.read_config(spark, str(tmp_path / "none.yaml"), defaults) == defaults


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("a", "b"):
        lines = [rng.choice(["", json.dumps({"n": i, "x": "y" * rng.randint(0, 60)})]) for i in range(700)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        want[name] = [(i, x) for i, x in enumerate(lines, 1) if x]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 5
        rows = files.read_jsonl_numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, lines in want.items():
        assert sorted((r["line"], r["raw"]) for r in rows if r["file"].endswith(f"{name}.jsonl")) == lines


def test_long_reports_are_not_cut(spark):
    with pytest.raises(ValueError, match="more than 5"):
        files.markdown_table(spark.range(6), "t", limit=5)
    assert files.markdown_table(spark.range(5), "t", limit=5).count("\n") == 9


def test_many_groups_are_split_in_order(spark):
    """100,000 groups: no task orders them all, and the result is that of one sorted list."""
    rows = spark.range(230_000).select((F.col("id") % 100_000).alias("g"))
    split = group_split(rows.unionAll(spark.range(30_000).select(F.lit(7).alias("g"))), "g")
    got = {r["g"]: (r["n"], r["bucket"]) for r in split.collect()}
    sizes = Counter(i % 100_000 for i in range(230_000)) + Counter({7: 30_000})
    order = sorted(sizes, key=lambda g: (-sizes[g], str(g)))
    rest, before = sum(sizes.values()) - sizes[order[-1]], 0
    order_by_number = sorted(sizes, key=lambda g: (-sizes[g], g))
    if split.schema["g"].dataType.simpleString() != "string":
        order = order_by_number
    for g in order:
        want = "test" if g == order[-1] else "train" if before < 0.8 * rest else "validation"
        assert got[g if g in got else str(g)] == (sizes[g], want)
        before += sizes[g]
    ranks = {r["g"]: r["rank"] for r in count_ranks(rows, "g").collect()}
    assert ranks[0] == 1 and ranks[99_999] == 100_000 and len(set(ranks.values())) == 100_000




def test_counts_on_a_stream_count_each_finding_once(spark, tmp_path):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kind = f"{SCHEMA}, is_valid boolean, seen_at string"
    row = lambda i, at, valid=True, **x: (*(finding(finding_id=f"FND-{i:06d}", **x)[n] for n in names), valid, at)
    quiet = dict(severity="medium", cvss=(5.0, None), retest=(False, None, []))
    runs = [
        [row(1, "2024-01-01 00:10:00"), row(2, "2024-01-01 00:20:00", valid=False), row(3, "2024-01-01 01:10:00", **quiet)],
        [row(1, "2024-01-01 00:10:00"), row(3, "2024-01-01 01:40:00", **quiet), row(4, "2024-01-01 01:50:00", valid=None), row(5, "2024-01-01 01:55:00")],
        [row(9, "2024-01-09 00:00:00")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, kind).withColumn("seen_at", F.col("seen_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        like = spark.createDataFrame([], kind).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
        counts = review_stream.review_counts(review_stream.files_as_stream(spark, f"{tmp_path}/in", like))
        review_stream.run_once(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["window_start"].hour, r["outcome"]): r["n"] for r in spark.read.schema("window_start timestamp, outcome string, n long").parquet(f"{tmp_path}/out").collect()}
    once = spark.createDataFrame([r for rows in runs for r in rows], kind).dropDuplicates(["finding_id"])
    status = {r["finding_id"]: r["review_status"] for r in review(once, only=["review_status"]).collect()}
    want = Counter([(0, status["FND-000001"]), (0, "error"), (1, status["FND-000003"]), (1, "error"), (1, status["FND-000005"])])
    assert got == dict(want)


def scanned(df):
    """Rows that the scans of a finished plan gave out."""
    df.collect()
    found, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_look_ups_read_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 != 0, F.col("id") * 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    lookup.write_keyed(rows.unionAll(rows.where("k = 30")), f"{tmp_path}/t", "k", row_group=1 << 16)
    keys = spark.createDataFrame([("30",), ("30",), ("299997",), ("31",), (None,), ("x",)], "k string")
    got = lookup.look_up(spark, f"{tmp_path}/t", "k", keys)
    assert sorted(r["k"] for r in got.collect()) == [30, 30, 299997]
    assert scanned(got) < 20_000  # of 200,001
    absent = lookup.look_up(spark, f"{tmp_path}/t", "k", spark.createDataFrame([(100_000,)], "k long"))
    assert absent.collect() == [] and scanned(absent) == 0  # the Bloom filter knows that it is not there
    many = spark.range(1000).select((F.col("id") * 3).alias("k"))
    assert lookup.look_up(spark, f"{tmp_path}/t", "k", many).count() == 1000  # one of them null in the table, one there twice
    assert lookup.look_up(spark, f"{tmp_path}/t", "k", keys.limit(0)).collect() == []
