import os

import pytest
from hypothesis import given, settings, strategies as st

from portolan.functions.text import header_name
from portolan.operators import labels, ports
from portolan.schemas import TABLES
from portolan.sinks.tables import write_partitioned
from portolan.sources.labels import (
    label_files, read_label_blocks, read_label_lines, read_label_staging,
)
from tests.helpers import LABEL_TEXT, plan


@pytest.fixture(scope="module")
def label_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("labels") / "labels.txt"
    path.write_bytes(LABEL_TEXT.encode())
    return str(path)


@pytest.fixture(scope="module")
def staging(spark, label_file):
    blocks = read_label_blocks(spark, label_file)
    labels.require_blocks(blocks)
    return labels.parse_labels(labels.select_blocks(blocks)).drop("source")


def pairs(staging, kind):
    return {r.code: r.value for r in labels.of_type(staging, kind).collect()}


def test_blocks(spark, label_file):
    blocks = read_label_blocks(spark, label_file)
    assert blocks.count() == 8
    kinds = [r.type for r in labels.select_blocks(blocks).collect()]
    assert sorted(kinds) == ["country", "i94_mode", "port", "state", "visa"]


def test_pairs(staging):
    assert pairs(staging, "country") == {
        "501": "NORDLAND Air Sea, and Not Counted (X-1, no land)",
        "502": "SUDLAND", "503": "INVALID: FAR ISLES (NORTH/SOUTH TERR.)",
        "0": "INVALID: NOWHERE", "996": "No Land Code (996)"}
    assert pairs(staging, "i94_mode") == {"1": "Wings", "2": "Hull", "3": "Wheels", "9": "Not told"}
    assert pairs(staging, "visa") == {"1": "Trade", "2": "Leisure trip", "3": "Study"}
    assert pairs(staging, "state")["99"] == "Any Other Code"
    assert len(pairs(staging, "state")) == 13
    found = pairs(staging, "port")
    assert len(found) == 17
    assert found["EEE"] == "MIDL FALLS, MN" and found["CP"] == "No PORT Code (CP)"
    assert {"AG", "NK", "888"} <= found.keys()


def test_dims(staging):
    dims = labels.build_dims(staging)
    for name, dim in dims.items():
        assert dim.schema.simpleString() == TABLES[name].simpleString()
    assert {tuple(r) for r in dims["dim_visa"].collect()} == {
        (1, "Trade"), (2, "Leisure trip"), (3, "Study")}
    assert dims["dim_country"].where("region_key = 0").first().region_name == "INVALID: NOWHERE"


def test_ports(staging):
    assert {tuple(r) for r in labels.build_port_dim(staging).collect()} == {
        ("AAA", "AK", "ARDEN"), ("BBB", "CA", "BRISK ARPT"), ("CCC", "AR", "LOW ROCK BPS"),
        ("DDD", "AZ", "MARLOW"), ("EEE", "MN", "MIDL FALLS"), ("FFF", "NY", "LA GRANJA"),
        ("GGG", "NC", "ELM OAK"), ("HHH", "OH", "UP IN ARMS"),
        ("PDN", "TX", "PASO DEL NORTE"), ("BLI", "WA", "BELLINGHAM WASHINGTON")}


def parsed(spark, kind, text):
    """(pairs, rejects) of one block."""
    selected = spark.createDataFrame([("s", kind, text)], "source string, type string, block string")
    return ({r.code: r.value for r in labels.parse_labels(selected).collect()},
            {(r.entries, r.rejected) for r in labels.label_rejects(selected).collect()})


def test_an_empty_or_doubled_quote_does_not_run_on(spark):
    text = "'DEF' = ''\r\n'GHI' = 'Z, NY'\r\n'JKL' = 'O''HARE'\r\n'MNO' = @@\r\n'P''Q' = 'x'"
    assert parsed(spark, "port", text.replace("@@", "'" * 4)) == ({
        "DEF": "", "GHI": "Z, NY", "JKL": "OHARE", "MNO": "", "PQ": "x"}, set())
    assert parsed(spark, "visa", "  1 = Two words\r\n 2 =\r\n 3 = a = b\r\n*/") == (
        {"1": "Two words", "2": "", "3": "a = b"}, set())


def test_entries_of_another_shape_are_counted_and_refused(spark, tmp_path):
    assert parsed(spark, "state", "'NY'='A'\r\n'ny'='B'\r\n'ABC'='C'\r\nTX='D'") == (
        {"NY": "A"}, {(4, 3)})
    assert parsed(spark, "country", " 1 = 'A'\r\n '2' = 'B'\r\n 3 = C") == ({"1": "A"}, {(3, 2)})
    (tmp_path / "l.txt").write_bytes(LABEL_TEXT.replace("'AK'=", "'ak'=").encode())
    with pytest.raises(labels.LabelBlockError, match=r"\(1 of 1\): 1 of 13 state in .*'ak'"):
        labels.require_blocks(read_label_blocks(spark, str(tmp_path)))


def test_an_empty_file_lacks_every_list(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(LABEL_TEXT.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    blocks, files = read_label_blocks(spark, str(tmp_path)), label_files(spark, str(tmp_path))
    faults = {(r.source.rpartition("/")[2], r.type): r.blocks
              for r in labels.block_faults(blocks, files).collect()}
    assert faults == {("b.txt", kind): 0 for kind in labels.LISTS}
    with pytest.raises(labels.LabelBlockError, match=r"\(5 of 5\)"):
        labels.require_blocks(blocks, files)


def test_port_edges(spark):
    states = spark.createDataFrame([("NY",), ("LA",), (None,)], "code string")
    rows = spark.createDataFrame(
        [("A", "NY"), ("B", "NY, NY"), ("C", ""), ("D", None), ("E", "x ny"),
         ("F", "TOOLONG"), ("'G'", "'NEW' LA, NY (LA)")], "code string, value string")
    found = {r.port_key: (r.state, r.address) for r in ports.build_ports(rows, states).collect()}
    assert found == {"A": ("NY", ""), "B": ("NY", "NY"), "G": ("LA", "NEW LA NY")}


@pytest.mark.parametrize("code", ["TOOLONG", "ny"])
def test_a_state_code_of_another_shape_is_refused(spark, code):
    """Left out, it would take the ports of its state with it."""
    states = spark.createDataFrame([("NY",), (code,)], "code string")
    rows = spark.createDataFrame([("A", "X, NY")], "code string, value string")
    with pytest.raises(Exception, match=f"not a state code: {code}"):
        ports.build_ports(rows, states).collect()


def test_no_states_means_no_ports(spark):
    states = spark.createDataFrame([], "code string")
    rows = spark.createDataFrame([("A", "X, NY")], "code string, value string")
    assert ports.build_ports(rows, states).isEmpty()


def test_block_faults(spark):
    blocks = spark.createDataFrame(
        [("a", "I94PORT x"), ("a", "more I94PORT"), ("a", "I94CIT & I94RES"), ("a", "I94MODE"),
         ("a", "I94ADDR I94VISA"), ("b", "nothing")], "source string, block string")
    faults = {(r.source, r.type): r.blocks for r in labels.block_faults(blocks).collect()}
    assert faults == {("a", "port"): 2, **{("b", k): 0 for k in labels.LISTS}}
    with pytest.raises(labels.LabelBlockError, match="port x2 in a"):
        labels.require_blocks(blocks)
    # One block may hold two lists.
    both = labels.select_blocks(blocks).where("source = 'a'").select("type").collect()
    assert sorted(r.type for r in both) == ["country", "i94_mode", "port", "port", "state", "visa"]


def test_a_block_mark_inside_a_label_is_refused(spark, tmp_path):
    cut = LABEL_TEXT.replace("TARN, ELSEWHERE", "TARN; ELSEWHERE")
    (tmp_path / "l.txt").write_bytes(cut.encode())
    with pytest.raises(labels.LabelBlockError, match="port in "):
        labels.require_blocks(read_label_blocks(spark, str(tmp_path)))


@pytest.mark.skipif("LABEL_FILE" not in os.environ, reason="LABEL_FILE names no label text")
def test_full_label_file(spark):
    """Sizes of the full code lists, for whoever has the file at hand."""
    blocks = read_label_blocks(spark, os.environ["LABEL_FILE"])
    labels.require_blocks(blocks)
    staging = labels.parse_labels(labels.select_blocks(blocks)).drop("source")
    assert {r.type: r["count"] for r in staging.groupBy("type").count().collect()} == {
        "port": 660, "country": 289, "state": 55, "i94_mode": 4, "visa": 3}
    us_ports = labels.build_port_dim(staging)
    assert us_ports.count() == us_ports.select("port_key").distinct().count() == 526


def test_many_files_at_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"l{i}.txt").write_bytes(LABEL_TEXT.encode())
    blocks = read_label_blocks(spark, str(tmp_path))
    labels.require_blocks(blocks)
    counts = labels.parse_labels(labels.select_blocks(blocks)).groupBy("source").count().collect()
    assert [r["count"] for r in counts] == [42, 42, 42]


def test_port_plan(staging):
    text = plan(labels.build_port_dim(staging))
    assert "EvalPython" not in text
    for join in ("CartesianProduct", "NestedLoopJoin", "BroadcastHashJoin", "SortMergeJoin"):
        assert join not in text


def test_each_dim_reads_its_own_list(spark, staging, tmp_path):
    path = str(tmp_path / "staging")
    write_partitioned(staging, path, ["type"])
    dims = labels.build_dims(read_label_staging(spark, path))
    for name, kind in [("dim_country", "country"), ("dim_visa", "visa"), ("dim_state", "state")]:
        text = plan(dims[name])
        assert "PartitionFilters: [isnotnull(type" in text and f"= {kind})]" in text
    ports_plan = plan(dims["dim_port"])
    assert "= port)]" in ports_plan and "= state)]" in ports_plan
    assert dims["dim_port"].count() == 10


# Line by line

def of_lines(spark, path, one_text=False):
    lines = read_label_lines(spark, str(path), one_text)
    selected = labels.listed_lines(lines)
    labels.require_lists(lines, selected, label_files(spark, str(path), one_text))
    return labels.parse_labels(selected)


def test_lines_give_what_blocks_give(spark, label_file, staging):
    got = of_lines(spark, label_file).drop("source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, staging.collect()))


@pytest.mark.parametrize("files,split", [(1, 60), (7, 10**9), (40, 200)])
def test_a_list_goes_on_over_splits_and_files(spark, staging, tmp_path, files, split):
    """The text cut between lines into files, and files into splits, anywhere."""
    text = LABEL_TEXT.split("\r\n")
    step = -(-len(text) // files)
    for at in range(0, len(text), step):
        (tmp_path / f"part-{at // step:05}.txt").write_bytes(
            "".join(f"{line}\r\n" for line in text[at:at + step]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(map(tuple, of_lines(spark, tmp_path, one_text=True).drop("source").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(tuple, staging.collect()))


def test_files_of_their_own_stay_apart_line_by_line(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"l{i}.txt").write_bytes(LABEL_TEXT.encode())
    counts = of_lines(spark, tmp_path).groupBy("source").count().collect()
    assert [r["count"] for r in counts] == [42, 42, 42]
    with pytest.raises(labels.LabelBlockError, match="port x3 in all files"):
        of_lines(spark, tmp_path, one_text=True)


def selected_lines(spark, *texts):
    lines = spark.createDataFrame([("s", "f", 0, i, t) for i, t in enumerate(texts)],
                                  "source string, file string, split bigint, at bigint, line string")
    return [(r.type, r.block) for r in labels.listed_lines(lines).collect()]


def test_where_a_list_begins_and_ends(spark):
    assert selected_lines(
        spark, "x", "/* I94PORT */ 'NO' = 'ENTRY'", " 'A' = 'B; C' ", " 'D'='E' ; 'F'='G'", "'H'='I'",
        "I94MODE", "1 = 'a'", "I94VISA x", "1 = it's", "2 = b;3 = c", "I94ADDR; gone", "'NY'='N'") == [
        ("port", " 'A' = 'B; C' "), ("port", " 'D'='E' "), ("i94_mode", "1 = 'a'"), ("visa", "1 = it's"),
        ("visa", "2 = b")]
    assert selected_lines(spark, "a", "b") == []


@pytest.mark.parametrize("old,new,message", [
    ("/* I94PORT -", "/* PORTS -", "port x0"), ("value model", "/* I94MODE */", "i94_mode x2"),
    ("BRISK, CA -ARPT", "BRISK, CA '-ARPT", "a label runs over its line .*port"),
    ("'AK'=", "'ak'=", r"1 of 13 state in .*'ak'")])
def test_faults_of_lines_are_refused(spark, tmp_path, old, new, message):
    assert old in LABEL_TEXT
    (tmp_path / "l.txt").write_bytes(LABEL_TEXT.replace(old, new).encode())
    with pytest.raises(labels.LabelBlockError, match=message):
        of_lines(spark, tmp_path)


def test_an_empty_text_lacks_every_list(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"")
    for one_text in (True, False):
        with pytest.raises(labels.LabelBlockError, match=r"\(5 of 5\)"):
            of_lines(spark, tmp_path, one_text)


def test_a_long_list_is_spread_over_tasks(spark, tmp_path):
    """No group by list: rows of one list come out of many tasks."""
    spark.range(60_000).selectExpr("concat('   ', char(39), id, char(39), '=', char(39), 'P', id, char(39))").coalesce(
        1).write.text(str(tmp_path / "body"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "body").glob("part-*")))
    (tmp_path / "l.txt").write_text("/* I94PORT */\n" + body + ";\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        selected = labels.listed_lines(read_label_lines(spark, str(tmp_path / "l.txt")))
        parsed = labels.parse_labels(selected)
        assert (parsed.count(), parsed.select("code").distinct().count()) == (60_000, 60_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


NAMES = st.text("ABC xyz,.-/()#", min_size=1, max_size=20).filter(lambda s: s.strip())


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.text("ABCXYZ019", min_size=1, max_size=4), NAMES, min_size=1, max_size=6))
def test_rendered_ports_parse_back(spark, wanted):
    lines = "\r\n".join(f"   '{code}'\t=\t'{label}'" for code, label in wanted.items())
    selected = spark.createDataFrame(
        [("s", "port", "/* I94PORT */ value $x\r\n" + lines)],
        "source string, type string, block string")
    got = {r.code: r.value for r in labels.parse_labels(selected).collect()}
    assert got == {code: label.strip(" ") for code, label in wanted.items()}


def test_header_names():
    assert [header_name(n) for n in ["Foreign-born", " Median  Age", "State Code", "race"]] == [
        "foreign_born", "median_age", "state_code", "race"]
