import json

from pyspark.sql import functions as F

from lintlake.operators import code, code_rules
from lintlake.operators.findings import with_identities
from lintlake.sources import sinks
from lintlake.streaming.hook import stream_new_findings

KIND = "rule_id string, file_path string, line int, end_line int, `column` int, symbol string, severity string, message string"


def test_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a.b", "x,y.py", 3, 3, 1, "f", "advisory", "50% done\nnow|"), ("a.b", "z.py", None, None, None, None, "error", "m")], KIND)
    found = with_identities(rows).orderBy("file_path")
    assert [r[0] for r in found.select(sinks.annotation()).collect()] == ["::notice file=x%2Cy.py,line=3,title=a.b::50%25 done%0Anow|", "::error file=z.py,title=a.b::m"]
    one = json.loads(found.select(sinks.sarif_result()).first()[0])
    assert one["ruleId"] == "a.b" and one["level"] == "note" and one["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert found.select(sinks.markdown_row()).collect()[1][0] == "| error | a.b | z.py | m |"
    sinks.write_json(found, str(tmp_path / "base"))
    assert sinks.read_baseline(spark, str(tmp_path / "base")).count() == 2
    sinks.write_lines(found, sinks.annotation(), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_stream_appends_only_new_findings(spark, tmp_path):
    kind = "project string, path string, file_type string, source string"
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def rule(batch):
        calls = code.nodes(batch).where("kind = 'Call' and text in ('eval', 'exec')")
        return code_rules.finding(calls, "a.call", "error", "security").withColumn("message", F.lit("call"))

    for text in ("def f(x):\n    return eval(x)\n", "def f(x):\n    y = 1\n    return eval(x)\ndef g(x):\n    exec(x)\n"):
        spark.createDataFrame([("p", "a.py", "python", text)], kind).write.mode("append").parquet(source)
        stream_new_findings(spark.readStream.schema(kind).parquet(source), rule, out, mark).awaitTermination(90)
    got = sorted((r["batch"], r["symbol"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "f"), (1, "g")]
