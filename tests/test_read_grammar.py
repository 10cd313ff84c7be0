"""What read commands show, form by form."""

from pyspark.sql import functions as F

from tracewell.functions import commands

READS = [
    ("cat a.py", ("a.py", "FULL_FILE", None, None, True)),
    ("  cat 'my file.py'  ", ("my file.py", "FULL_FILE", None, None, True)),
    ('type "C:\\a b\\c.txt"', ("C:\\a b\\c.txt", "FULL_FILE", None, None, True)),
    ("head -n 5 'a b.py'", ("a b.py", "LINE_RANGE", 1, 5, True)),
    ("head -7 a.py", ("a.py", "LINE_RANGE", 1, 7, True)),
    ("tail -n 9 a.py", ("a.py", "TAIL", 9, None, True)),
    ("head -c 100 d.bin", ("d.bin", "BYTE_RANGE", 0, 100, True)),
    ("sed -n '3,8p' a.py", ("a.py", "LINE_RANGE", 3, 8, True)),
    ("Get-Content a.py", ("a.py", "FULL_FILE", None, None, True)),
    ("get-content -Raw -LiteralPath 'a b.py'", ("a b.py", "FULL_FILE", None, None, True)),
    ("Get-Content -Encoding utf8 -Path a.py", ("a.py", "FULL_FILE", None, None, True)),
    ("Get-Content -Tail 5 a.py", ("a.py", "TAIL", 5, None, True)),
    ('Get-Content "a.py" -TotalCount 12', ("a.py", "LINE_RANGE", 1, 12, True)),
    ("Get-Content a.py | Select-Object -Skip 10 -First 5", ("a.py", "LINE_RANGE", 11, 15, True)),
    ("Get-Content a.py | Select-Object -First 5 -Skip 10", ("a.py", "LINE_RANGE", 11, 15, True)),
    ("Get-Content a.py | select-object -First 5", ("a.py", "LINE_RANGE", 1, 5, True)),
    ("Get-Content a.py | Select-Object -Last 5", ("a.py", "TAIL", 5, None, True)),
    ("$ErrorActionPreference='Stop'; Get-Content 'a.py'", ("a.py", "FULL_FILE", None, None, True)),
    ("(Get-Content 'a.py')[0..9]", ("a.py", "LINE_RANGE", 1, 10, True)),
    ("(Get-Content a.py)[4..4]", ("a.py", "LINE_RANGE", 5, 5, True)),
    # not pure
    ("Get-Content a.py -Tail 5 | Select-Object -First 2", ("a.py", "OTHER", None, None, False)),
    ("Get-Content a.py | Select-Object -Unique", ("a.py", "OTHER", None, None, False)),
    ("Get-Content a.py | Select-String x", ("a.py", "OTHER", None, None, False)),
    ("Get-Content a.py | Select-Object -First 5 | Set-Content b", ("a.py", "OTHER", None, None, False)),
    ("Get-Content a.py > b.py", ("a.py", "OTHER", None, None, False)),
    ("cat 'a.py'; rm 'b.py'", ("a.py", "OTHER", None, None, False)),
    ("cd x; Get-Content -LiteralPath 'a'", ("a", "OTHER", None, None, False)),
    ("$ErrorActionPreference='Stop'; cat a.py; ls", (None, "OTHER", None, None, False)),
    ("cat 'a.py' | wc", ("a.py", "UNKNOWN", None, None, False)),
    ("cat a.py > b.py", (None, "UNKNOWN", None, None, False)),
    ("cat a.py && rm b", (None, "UNKNOWN", None, None, False)),
    ("rg x 'src/a.py'", ("src/a.py", "UNKNOWN", None, None, False)),
    ("head -n 99999999999999999999 a.py", ("a.py", "OTHER", None, None, False)),
    ("concatenate a.py", (None, "UNKNOWN", None, None, False)),
    ("", (None, "UNKNOWN", None, None, False)),
    (" ; ", (None, "UNKNOWN", None, None, False)),
    ("Get-Content", (None, "OTHER", None, None, False)),
    (None, None),
]


def test_every_form(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(READS)], "k int, command string")
    got = {r["k"]: r["view"] and tuple(r["view"]) for r in df.select("k", commands.read_view(F.col("command")).alias("view")).collect()}
    wrong = [(READS[k][0], v, READS[k][1]) for k, v in got.items() if v != READS[k][1]]
    assert not wrong


def test_bounds_that_no_number_holds_are_never_pure(spark):
    df = spark.createDataFrame([("tail -n 99999999999999999999 a.py",), ("sed -n 1,99999999999999999999p a.py",), ("(Get-Content a)[0..99999999999999999999]",), ("Get-Content a -Tail 99999999999999999999",), ("Get-Content",)], "command string")
    assert [r["p"] for r in df.select(commands.read_view(F.col("command"))["pure"].alias("p")).collect()] == [False] * 5


def test_one_name_for_a_source(spark):
    paths = [("'C:\\Src\\A.py'", "c:/src/a.py"), ("D:/X//y/./Z", "d:/x/y/z"), ("./Src//A.py", "Src/A.py"), ("a*.py", None), ("a>b", None), ("a|b", None), ("``", None), (" ", None), (None, None), ("a b.py", "a b.py")]
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(paths)], "k int, path string")
    assert {r["k"]: r["s"] for r in df.select("k", commands.source_identity(F.col("path")).alias("s")).collect()} == {k: s for k, (_, s) in enumerate(paths)}
