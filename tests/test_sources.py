"""Edge files of FIXTURES.md F1 through the season loader."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.functions.columns import parse_match_date
from touchline.sources.seasons import load_seasons, read_seasons, refresh_season, land_seasons

HEAD_A = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,HTAG,HTR,HS,AS,HST,AST,HC,AC,HF,AF,HY,AY,HR,AR,B365H,B365D,B365A"
HEAD_B = ("Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,HTAG,HTR,HS,AS,HST,AST,HHW,AHW,HC,AC,HF,AF,"
          "HO,AO,HY,AY,HR,AR,B365A,B365D,B365H")


def _write(folder, name, lines, encoding="ISO-8859-1"):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(("\n".join(lines) + "\n").encode(encoding))


@pytest.fixture(scope="module")
def season_dir():
    d = tempfile.mkdtemp(prefix="seasons-")
    _write(d, "s1.csv", [
        HEAD_A,
        "19/08/00,Arsenal,Chelsea,2,1,H,1,0,H,10,8,5,3,6,4,12,11,2,1,0,0,2.0,3.25,3.5",
        # long row: one field too many -> skipped
        "20/08/00,Arsenal,Leeds,1,1,D,0,0,D,9,9,4,4,5,5,10,10,1,1,0,0,2.5,3.0,2.8,EXTRA",
        # long row, hard: surplus field empty (trailing comma) -> skipped
        "21/08/00,Leeds,Chelsea,0,2,A,0,1,A,7,12,2,6,3,7,13,9,3,2,1,0,3.0,3.1,2.2,",
        # short row with a quoted comma in a name -> kept, tail null
        '1/8/93,"Nott\'m, Forest",Chelsea,3,0,H,2,0,H,15',
        # blank row -> dropped (no date, no result)
        ",,,,,,,,,,,,,,,,,,,,,,,",
        # invalid dates -> null -> dropped
        "99/99/2021,Arsenal,Chelsea,1,0,H,0,0,D,5,5,2,2,1,1,5,5,0,0,0,0,2.0,3.0,4.0",
        "31/02/20,Arsenal,Chelsea,1,0,H,0,0,D,5,5,2,2,1,1,5,5,0,0,0,0,2.0,3.0,4.0",
    ])
    # second header: extra Time column after Date, different order, latin-1 name
    _write(d, "s2.csv", [
        HEAD_B,
        "E0,13/08/2021,15:00,Brentford,Arsenal,2,0,H,1,0,H,8,22,3,4,1,0,2,5,12,8,1,2,0,0,0,0,1.8,3.5,4.5",
        "E0,14/08/2021,15:00,Man United,Leeds,5,1,H,1,0,H,16,10,8,3,,,5,4,11,9,,,1,2,0,0,6.0,4.5,1.6",
        "E0,14/08/2021,17:30,Cr\xe9teil,Leeds,1,1,D,0,0,D,5,5,2,2,0,0,3,3,9,9,1,1,1,1,0,0,3.0,3.0,NaN",
    ])
    return d


def test_loader_edge_rows(spark, season_dir):
    df = read_seasons(spark, season_dir)
    rows = {(r.match_date, r.home_team, r.away_team): r for r in df.collect()}
    keys = set(rows)
    assert (dt.date(2000, 8, 19), "Arsenal", "Chelsea") in keys
    assert (dt.date(1993, 8, 1), "Nott'm, Forest", "Chelsea") in keys       # short row kept, 1993 pivot
    assert all(k[2] != "Leeds" or k[1] != "Arsenal" for k in keys)          # long row skipped
    assert (dt.date(2000, 8, 21), "Leeds", "Chelsea") not in keys           # trailing-comma long row skipped
    assert len(keys) == 5
    short = rows[(dt.date(1993, 8, 1), "Nott'm, Forest", "Chelsea")]
    assert short.hs == 15 and short.as_ is None and short.b365h is None
    # second header resolved by name, not position
    b = rows[(dt.date(2021, 8, 13), "Brentford", "Arsenal")]
    assert (b.fthg, b.ftag, b.hs, b.as_, b.hhw, b.ahw, b.ho, b.ao) == (2, 0, 8, 22, 1, 0, 1, 2)
    assert (b.b365h, b.b365d, b.b365a) == (4.5, 3.5, 1.8)
    assert (dt.date(2021, 8, 14), "Créteil", "Leeds") in keys          # latin-1 decoded
    assert rows[(dt.date(2021, 8, 14), "Créteil", "Leeds")].b365h is None  # NaN text -> null
    a = rows[(dt.date(2000, 8, 19), "Arsenal", "Chelsea")]
    assert a.hhw is None and a.season_year == 2000
    assert b.season_year == 2021 and short.season_year == 1993


def test_long_rows_skipped_after_landing_even_for_narrow_reads(spark, season_dir):
    df = load_seasons(spark, season_dir)
    assert df.select("home_team").count() == 5
    assert df.where(F.col("away_team") == "Leeds").where(F.col("home_team") == "Arsenal").count() == 0


def test_date_forms(spark):
    cases = ["19/08/00", "1/8/93", "13/08/2021", "99/99/2021", "31/02/20", "01/01/69", "31/12/68"]
    got = [r.d for r in spark.createDataFrame([(c,) for c in cases], "t string")
           .select(parse_match_date("t").alias("d")).collect()]
    assert got == [dt.date(2000, 8, 19), dt.date(1993, 8, 1), dt.date(2021, 8, 13), None, None,
                   dt.date(1969, 1, 1), dt.date(2068, 12, 31)]


def test_refresh_replaces_only_landed_season(spark, season_dir):
    table = tempfile.mkdtemp(prefix="table-") + "/t"
    land_seasons(spark, season_dir, table)
    landed = tempfile.mkdtemp(prefix="landed-")
    _write(landed, "cur.csv", [
        "Date,HomeTeam,AwayTeam,FTR,FTHG,FTAG",
        "20/08/2021,Arsenal,Chelsea,A,0,2",
    ], encoding="utf-8")
    out = refresh_season(spark, landed, table, 2021)
    by_season = {r.season_year: r.n for r in out.groupBy("season_year").agg(F.count("*").alias("n")).collect()}
    assert by_season == {1993: 1, 2000: 1, 2021: 1}


def test_strict_reader_raises_on_long_row(spark):
    landed = tempfile.mkdtemp(prefix="landed-")
    _write(landed, "cur.csv", ["Date,HomeTeam,AwayTeam,FTR", "20/08/2021,Arsenal,Chelsea,A,EXTRA"])
    with pytest.raises(Exception):
        read_seasons(spark, landed, encoding="UTF-8", strict=True).collect()


def test_file_order_does_not_matter(spark, season_dir):
    """Same files under other names (so listed in the other order): same rows."""
    other = tempfile.mkdtemp(prefix="seasons-swapped-")
    for src, dst in (("s1.csv", "z_first.csv"), ("s2.csv", "a_second.csv")):
        with open(os.path.join(season_dir, src), "rb") as f, open(os.path.join(other, dst), "wb") as g:
            g.write(f.read())
    cols = read_seasons(spark, season_dir).columns  # the ids too
    a = sorted(tuple(r) for r in read_seasons(spark, season_dir).select(*cols).collect())
    b = sorted(tuple(r) for r in read_seasons(spark, other).select(*cols).collect())
    assert a == b and len(a) == 5


def test_empty_file_is_ignored(spark, season_dir):
    other = tempfile.mkdtemp(prefix="seasons-empty-")
    with open(os.path.join(season_dir, "s1.csv"), "rb") as f, open(os.path.join(other, "s1.csv"), "wb") as g:
        g.write(f.read())
    open(os.path.join(other, "broken.csv"), "wb").close()
    df = read_seasons(spark, other)
    # a count-only query prunes every column: long rows must still be skipped
    assert df.count() == len(df.collect()) == 2


def test_date_text_variants_and_season_start(spark):
    from touchline.functions.columns import season_year
    got = [r.d for r in spark.createDataFrame([(" 19/08/00 ",), ("2021-08-13",), ("7/1/1999",)], "t string")
           .select(parse_match_date("t").alias("d")).collect()]
    assert got == [dt.date(2000, 8, 19), None, dt.date(1999, 1, 7)]   # one day-first rule everywhere
    days = spark.createDataFrame([(dt.date(2021, 7, 31),), (dt.date(2021, 8, 1),), (dt.date(2022, 1, 5),)], "d date")
    assert [r.s for r in days.select(season_year("d").alias("s")).collect()] == [2020, 2021, 2021]
    assert [r.s for r in days.select(season_year("d", 1).alias("s")).collect()] == [2021, 2021, 2022]


ROW = "20/08/2021,Arsenal,Chelsea,{},1,0"
HEAD = "Date,HomeTeam,AwayTeam,FTR,FTHG,FTAG"


def _folder(lines, name="a.csv"):
    d = tempfile.mkdtemp(prefix="seasons-")
    _write(d, name, lines)
    return d


def test_repeated_lines_are_rows_of_their_own(spark):
    from touchline.plans.features import training_features
    days = [f"{d}/08/2021,Arsenal,Chelsea,H,1,0" for d in (20, 21, 22, 22, 23)]
    df = load_seasons(spark, _folder([HEAD, *days]))
    assert df.count() == 5 and df.select("match_id").distinct().count() == 5
    assert training_features(df, keep_cold_start=True).count() == 5


def test_ids_do_not_depend_on_the_landing_path(spark):
    table = tempfile.mkdtemp(prefix="table-") + "/t"
    old = _folder([HEAD, "20/08/2020,Arsenal,Leeds,A,0,1", ROW.format("H"), ROW.format("H")])
    first = {tuple(r) for r in land_seasons(spark, old, table).select("match_id", "match_date").collect()}
    again = refresh_season(spark, _folder([HEAD, ROW.format("H"), ROW.format("H")], "z.csv"), table, 2021)
    assert {tuple(r) for r in again.select("match_id", "match_date").collect()} == first and len(first) == 3


def test_refresh_refuses_rows_of_another_season(spark):
    table = tempfile.mkdtemp(prefix="table-") + "/t"
    full = land_seasons(spark, _folder([HEAD] + [f"{d}/09/2019,Arsenal,Leeds,H,1,0" for d in range(1, 5)]
                                       + [ROW.format("H")]), table)
    before = sorted(map(tuple, full.select("match_id").collect()))
    for landed in (_folder([HEAD, ROW.format("A"), "1/9/2019,Arsenal,Leeds,H,1,0"]), _folder([HEAD])):
        with pytest.raises(ValueError):
            refresh_season(spark, landed, table, 2021)
    assert sorted(map(tuple, spark.read.parquet(table).select("match_id").collect())) == before


def test_header_without_date_raises(spark):
    d = _folder([HEAD, ROW.format("H")])
    _write(d, "b.csv", [HEAD.replace("Date", "Datum"), ROW.format("H")])
    for strict in (False, True):
        with pytest.raises(ValueError, match="Datum"):
            read_seasons(spark, d, strict=strict)


def test_unknown_result_raises(spark):
    with pytest.raises(Exception, match="unknown result"):
        read_seasons(spark, _folder([HEAD, ROW.format("H"), ROW.format("X")])).collect()


def test_headers_take_one_job(spark):
    """The number of jobs does not depend on the number of files."""
    from touchline.sources.seasons import headers
    jobs = []
    for n in (4, 12):
        d = tempfile.mkdtemp(prefix="seasons-")
        for i in range(n):
            _write(d, f"s{i}.csv", [HEAD, ROW.format("H")])
        sc = spark.sparkContext
        sc.setJobGroup(f"headers-{n}", "headers")
        assert [len(v) for v in headers(spark, d).values()] == [n]
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"headers-{n}")))
        sc.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_a_line_is_parsed_once(spark, tmp_path):
    """Filters and columns take a line's fields from one parse, however many they read."""
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,FTR,FTHG\n01/02/96,a,b,H,1\n1/12/1997,c,d,A,\n,e,f,H,2\n")
    df = read_seasons(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1
    assert sorted((r.home_team, str(r.match_date), r.ftr, r.fthg) for r in df.collect()) == [
        ("a", "1996-02-01", "H", 1), ("c", "1997-12-01", "A", None)]
