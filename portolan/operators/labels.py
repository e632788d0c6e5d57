"""Label blocks or lines to staging rows to dimensions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from portolan.functions.text import plain_text
from portolan.operators.ports import build_ports

SHOWN = 10  # faults that an error message spells out


class LabelList(NamedTuple):
    keyword: str    # marks the list's block
    entry: str      # `code = label` as this list prints it; groups: code, label


_QUOTED = "'([^']*(?:''[^']*)*)'"

# List type, the keyword that marks its block, and the shape of
# one entry in it. A state code is two characters of A-Z or 9.
LISTS = {
    "port": LabelList("I94PORT", rf"{_QUOTED}\s*=\s*{_QUOTED}"),
    "country": LabelList("I94CIT & I94RES", rf"([0-9]+)\s*=\s*{_QUOTED}"),
    "i94_mode": LabelList("I94MODE", rf"([0-9]+)\s*=\s*{_QUOTED}"),
    "visa": LabelList("I94VISA", r"([0-9]+)\s*=[ \t]*([^\r\n]*)"),
    "state": LabelList("I94ADDR", rf"'([A-Z9]{{2}})'\s*=\s*{_QUOTED}"),
}

# What looks like an entry of any list: a quoted or plain code, and a quoted label
# or one that goes on to the line end. Matched on the text as it is printed, so a
# doubled quote or an empty label cannot run into the next entry.
_CLOSED = _QUOTED.replace("([^']*(", "(?:[^']*(")
ANY_ENTRY = rf"(?:{_CLOSED}|[^\s'=]+)\s*=[ \t]*(?:{_CLOSED}|[^\r\n]*)"


class LabelBlockError(ValueError):
    """A label file lacks a list, has it more than once, has entries that are not of
    their list's shape, or a `;` cuts a label."""


def select_blocks(blocks: DataFrame) -> DataFrame:
    """(source, type, block) for the blocks that hold a list."""
    block = F.col("block")
    types = F.array_compact(F.array(
        *[F.when(block.contains(of.keyword), F.lit(kind)) for kind, of in LISTS.items()]))
    return blocks.select("source", F.explode(types).alias("type"), "block")


# Line by line

# What a line holds before a `;` that is not in a quoted text. A quote without a partner
# is a character like any other.
_BEFORE_END = r"^((?:'[^']*'|[^;']+|')*)"


def _marked(lines: DataFrame) -> DataFrame:
    """`lines` with `text`, what comes before an end mark, and `list`: the list that the
    line opens, '' where it ends one, NULL where it does neither. The last keyword of a
    line counts; what stands on its line is no entry."""
    line = F.col("line")
    opened = F.array_max(F.array(*[
        F.struct(F.locate(of.keyword, line).alias("place"), F.lit(kind).alias("kind"),
                 F.lit(of.keyword).alias("keyword")) for kind, of in LISTS.items()]))
    marked = lines.withColumn("text", F.regexp_extract(line, _BEFORE_END, 1)).withColumn(
        "opened", F.when(opened.place > 0, opened))
    after = F.substr(line, F.col("opened.place"))
    ends = F.length("text") < F.length(line)
    return marked.withColumn("list", F.when(
        F.col("opened").isNotNull(), F.when(after.contains(";"), "").otherwise(F.col("opened.kind"))
    ).when(ends, "")).withColumn("opens", F.col("opened").isNotNull()).drop("opened")


def listed_lines(lines: DataFrame) -> DataFrame:
    """(source, type, block) of the lines within a list, for lines as they are read: a
    `block` is a line, up to an end mark.

    The list that was opened last is filled forward in two steps: along the lines of a
    split of a file (which is bounded by how Spark cuts files), and along the splits of a
    source, of which there is one row each, taken before the shuffle. So a list may be of
    any length and go on from file to file, and no row is larger than a line.
    """
    marked = _marked(lines)
    split = ["source", "file", "split"]
    last = F.max_by("list", F.when(F.col("list").isNotNull(), F.col("at")))
    carried = marked.groupBy(*split).agg(last.alias("last")).select(
        *[F.col(c).alias(f"_{c}") for c in split],
        F.last("last", ignorenulls=True).over(Window.partitionBy("source").orderBy(
            "file", "split").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    before = F.last("list", ignorenulls=True).over(Window.partitionBy(*split).orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1))
    filled = marked.withColumn("own", before)
    joined = filled.join(carried, reduce(Column.__and__, [
        F.col(c) == F.col(f"_{c}") for c in split]))
    return joined.withColumn("type", F.coalesce("own", "before", F.lit(""))).where(
        (F.col("type") != "") & ~F.col("opens")).select("source", "type", F.col("text").alias("block"))


def open_labels(selected: DataFrame) -> DataFrame:
    """(source, type, block) of lines of quoted lists whose quotes do not pair up: a label
    that runs over its line."""
    quotes = F.length("block") - F.length(F.replace("block", F.lit("'"), F.lit("")))
    return selected.where((F.col("type") != "visa") & (quotes % 2 == 1))


def require_lists(lines: DataFrame, selected: DataFrame, sources: DataFrame | None = None) -> None:
    """Raise for texts with faults, as `require_blocks` does for blocks; `selected` are
    the `listed_lines`. `;` may stand in a quoted label here."""
    _refuse(block_faults(lines.select("source", F.col("line").alias("block")), sources),
            "each list must occur once per label text",
            lambda f: f"{f.type} x{f.blocks} in {f.source}")
    _refuse(open_labels(selected), "a label runs over its line",
            lambda f: f"{f.type} in {f.source}, {f.block!r}")
    _refuse(label_rejects(selected), "entries are not of their list's shape",
            lambda f: f"{f.rejected} of {f.entries} {f.type} in {f.source}, {f.example!r}")


# Faults

def block_faults(blocks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, type, blocks) where a file does not hold a list exactly once.

    An empty file has no block to be seen by; `sources` (source) names all files.
    """
    block = F.col("block")
    counts = [F.count_if(block.contains(of.keyword)).alias(kind) for kind, of in LISTS.items()]
    counted = blocks.groupBy("source").agg(*counts)
    if sources is not None:
        counted = sources.join(counted, "source", "left")
    return counted.select("source", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("type"), F.coalesce(kind, F.lit(0)).alias("blocks"))
        for kind in LISTS]))).where("blocks <> 1")


def cut_labels(blocks: DataFrame) -> DataFrame:
    """(source, type) of quoted lists whose quotes do not pair up: a `;` inside a
    label ended the block early."""
    quotes = F.length("block") - F.length(F.replace("block", F.lit("'"), F.lit("")))
    return select_blocks(blocks).where((F.col("type") != "visa") & (quotes % 2 == 1)).select(
        "source", "type")


def _entry_shape() -> Column:
    shape = F.lit(None)
    for kind, of in LISTS.items():
        shape = F.when(F.col("type") == kind, F.lit(f"^{of.entry}$")).otherwise(shape)
    return shape


def printed_entries(selected: DataFrame) -> DataFrame:
    """(source, type, entry, accepted): everything in a list's block that looks like an
    entry, and whether it has the shape of its list."""
    entries = F.regexp_extract_all("block", F.lit(ANY_ENTRY), F.lit(0))
    return selected.select("source", "type", F.explode(entries).alias("entry")).withColumn(
        "accepted", F.regexp_like("entry", _entry_shape()))


def label_rejects(selected: DataFrame) -> DataFrame:
    """(source, type, entries, rejected, example) of the lists with entries that are
    not of their shape, and so not in staging."""
    rejected = ~F.col("accepted")
    return printed_entries(selected).groupBy("source", "type").agg(
        F.count("*").alias("entries"), F.count_if(rejected).alias("rejected"),
        F.min(F.when(rejected, plain_text(F.col("entry")))).alias("example")).where("rejected > 0")


def _refuse(faults: DataFrame, what: str, line: Callable) -> None:
    """Raise if there are faults; the message shows the first few and how many there are."""
    shown = faults.limit(SHOWN).collect()
    if shown:
        raise LabelBlockError(f"{what} ({len(shown)} of {faults.count()}): "
                              + ", ".join(map(line, shown)))


def require_blocks(blocks: DataFrame, sources: DataFrame | None = None) -> None:
    """Raise for files with faults. `block_faults`, `cut_labels` and `label_rejects`
    list them all."""
    _refuse(block_faults(blocks, sources), "each list must occur once per label file",
            lambda f: f"{f.type} x{f.blocks} in {f.source}")
    _refuse(cut_labels(blocks), "a label holds the block mark ';'",
            lambda f: f"{f.type} in {f.source}")
    _refuse(label_rejects(select_blocks(blocks)), "entries are not of their list's shape",
            lambda f: f"{f.rejected} of {f.entries} {f.type} in {f.source}, {f.example!r}")


def parse_labels(selected: DataFrame) -> DataFrame:
    """Staging rows (source, code, value, type), all lists in one pass.

    The reverse of five scans and a union: each block is matched once, then each
    entry with the shape of its own list; codes and labels are cleaned last.
    """
    entry = printed_entries(selected).where("accepted")
    shape = _entry_shape()
    return entry.select(
        "source", *[plain_text(F.call_function("regexp_extract", "entry", shape, F.lit(group)))
                    .alias(name) for group, name in ((1, "code"), (2, "value"))], "type")


def of_type(staging: DataFrame, kind: str) -> DataFrame:
    return staging.where(F.col("type") == kind)


def build_countries(staging: DataFrame) -> DataFrame:
    return of_type(staging, "country").select(
        F.col("code").try_cast("int").alias("region_key"), F.col("value").alias("region_name"))


def build_modes(staging: DataFrame) -> DataFrame:
    return of_type(staging, "i94_mode").select(
        F.col("code").try_cast("int").alias("i94mode_key"), F.col("value").alias("i94mode"))


def build_states(staging: DataFrame) -> DataFrame:
    return of_type(staging, "state").select(
        F.col("code").alias("state_code"), F.col("value").alias("state"))


def build_visas(staging: DataFrame) -> DataFrame:
    return of_type(staging, "visa").select(
        F.col("code").try_cast("int").alias("visa_key"),
        F.col("value").alias("visa_broad_type"))


def build_port_dim(staging: DataFrame) -> DataFrame:
    return build_ports(of_type(staging, "port"), of_type(staging, "state"))


# Dimension table name -> how it is made from staging.
DIMENSIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dim_port": build_port_dim,
    "dim_country": build_countries,
    "dim_i94_mode": build_modes,
    "dim_state": build_states,
    "dim_visa": build_visas,
}


def build_dims(staging: DataFrame) -> dict[str, DataFrame]:
    return {name: staging.transform(make) for name, make in DIMENSIONS.items()}
