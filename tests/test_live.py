"""Growing logs and scopes of tables in between."""

import json
import random

from pyspark.sql import functions as F

from engramlake import session
from engramlake.operators.memory import MemoryLog
from engramlake.sources.live import sections_between
from engramlake.streaming.live_logs import sync_stream


def test_each_section_comes_once_however_a_file_grows():
    r = random.Random(1)
    for _ in range(300):
        parts = ["".join(r.choice("ab#\n \u00e9") for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 6))]
        data = "\n## ".join(parts).encode()
        whole = [p.encode() for p in data.decode().split("\n## ")[1:]]
        cuts = sorted(r.sample(range(len(data) + 1), min(len(data), r.randrange(0, 5))))
        got, seen = [], 0
        for end in [*cuts, len(data)]:
            got += [t for _, t in sections_between(lambda a, b: data[a:b], seen, end, False)]
            seen = end
        got += [t for _, t in sections_between(lambda a, b: data[a:b], seen, seen, True)]
        assert got == whole, (data, cuts)


def test_a_log_that_is_appended_to_between_triggers(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = MemoryLog(spark, f"file://{tmp_path}/memory")
    run = lambda: sync_stream(MemoryLog(spark, log.root), f"file://{folder}").awaitTermination()
    titles = lambda: sorted(json.loads(x.raw)["title"] for x in log.entries().collect())
    day = folder / "2026-02-26.md"
    day.write_text("# Day\n\n## One\nfirst \u00e9\n\n## Two\nhal")
    (folder / "notes.md").write_text("# x\n## Not a log\ntext\n")
    run()
    assert titles() == ["One"]
    with day.open("a") as f:
        f.write("f of it\n\n## Three\nthird\n\n#")
    run()
    assert titles() == ["One", "Two"]
    with day.open("a") as f:
        f.write("# Four\nfourth\n")
    (folder / "2026-02-27.md").write_text("# Day\n\n## Five\nopen\n")
    run()
    run()
    assert titles() == ["Four", "One", "Three", "Two"]
    two = log.entries().filter(F.contains("raw", F.lit("Two"))).first()
    assert json.loads(two.raw)["outcome"] == "half of it" and json.loads(two.raw)["tags"] == ["daily-log", "2026-02-26"]


def test_a_scope_deletes_its_own_tables_alone(spark):
    kept = session.written(spark.range(3))
    with session.scope(spark):
        inner = session.written(spark.range(5))
        assert inner.count() == 5
        with session.scope(spark):
            deep = session.scratch(spark)
            spark.range(1).write.parquet(deep)
    path = spark._jvm.org.apache.hadoop.fs.Path(deep)
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path) and kept.count() == 3
