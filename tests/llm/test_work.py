"""What operators take besides their results: tasks of small tables, passes over the texts."""

import numpy as np

from milpa.llm import neardup, substrings


def tasks_of(spark, job) -> int:
    spark.sparkContext.setJobGroup("counted", "")
    job()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "")
    return sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)


def test_few_links_take_few_tasks(spark):
    """Each task leaves files and events, so tables of few rows are not to be read in as many tasks as shuffles have."""
    text = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*text[:i], f"x{i}", *text[i + 1 :]])) for i in range(40)] + [(50, " ".join(text)), (51, "alone"), (52, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {}
        tasks = tasks_of(spark, lambda: out.update({r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == {i: 0 for i in [*range(40), 50]} | {51: 51, 52: 52}
    assert tasks < 2000  # 4731 before


def test_texts_are_cut_into_contexts_once(spark, monkeypatch):
    seen, find = spark.sparkContext.accumulator(0), substrings._find_contexts

    def counting(*args):
        run = find(*args)

        def counted(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(substrings, "_find_contexts", counting)
    text = "".join(map(chr, np.random.default_rng(3).integers(97, 122, 300)))
    docs = spark.createDataFrame([(1, "zz" + text), (2, text + "yz"), (3, text[:200] + "!" + text[201:])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.removal_digests(docs, 250).collect()}
    assert got[1] == got[2] == 300
    assert seen.value == 3


def test_runs_of_stretches():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("lo", pa.int64()), ("stop", pa.int64()), ("passage", pa.bool_())]))
    found = [[(5, 9, False), (0, 5, False), (20, 30, False), (22, 24, False), (2, 4, True), (3, 8, True)], [(1, 2, True)], [], [(0, 3, False), (4, 6, False)]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([1, 2, 3, 4]), pa.array([[dict(zip(("lo", "stop", "passage"), x, strict=True)) for x in row] for row in found], kind)], names=["doc_id", "text_key", "found"])
    for part, at in ((batch, 0), (batch.slice(2), 2)):
        (out,) = substrings._merged([part])
        assert out.column("spans").to_pylist() == [[{"lo": 0, "stop": 9}, {"lo": 20, "stop": 30}], [], [], [{"lo": 0, "stop": 3}, {"lo": 4, "stop": 6}]][at:]
        assert out.column("passage_bytes").to_pylist() == [6, 1, 0, 0][at:]
