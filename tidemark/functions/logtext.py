"""Text of the structured archive log: rendering and parsing, as native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import names


def render_structured(time, pid, pairs) -> Column:
    """`time=... pid=... k=v ...`: time and pid first, the pairs sorted as text."""
    texts = F.transform(
        F.map_entries(names.col(pairs)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))
    )
    head = F.concat(F.lit("time="), names.log_time(time), F.lit(" pid="), names.col(pid).cast("string"))
    return F.concat_ws(" ", head, F.nullif(F.array_join(F.array_sort(texts), " "), F.lit("")))


def render_record(msg, detail, hint, structured) -> Column:
    """The lines of one record, absent ones left out."""

    def line(label, value):
        return F.when(names.col(value).isNotNull(), F.concat(F.lit(label), names.col(value)))

    return F.concat_ws(
        "\n", line("MSG: ", msg), line("DETAIL: ", detail), line("HINT: ", hint), line("STRUCTURED: ", structured)
    )


def render_indented(record, head="") -> Column:
    """A record as it stands in a log file: `head` (logger and level) before its first line, the others indented."""
    return F.concat(F.lit(head), F.replace(names.col(record), F.lit("\n"), F.lit("\n" + " " * 8)))


def record_parts(record) -> dict[str, Column]:
    """msg, detail, hint and structured of a record whose lines are not indented any more; absent ones are null.

    Labels count at the start of a line, the last one of a kind wins, and each value goes on to the next label.
    """
    rest, out = names.col(record), {}
    for part in ("structured", "hint", "detail"):
        mark = f"\n{part.upper()}: "
        value = F.when(rest.contains(mark), F.substring_index(rest, mark, -1))
        out[part] = value
        rest = F.when(value.isNull(), rest).otherwise(F.left(rest, F.length(rest) - F.length(value) - len(mark)))
    out["msg"] = F.when(rest.contains("MSG: "), F.regexp_replace(rest, r"(?s)^.*?MSG: ", ""))
    return out


def _padded(text) -> Column:
    return F.concat(F.lit(" "), names.col(text))


def _value_after(padded, mark) -> Column:
    tail = F.call_function("substring_index", padded, mark, F.lit(-1))
    return F.substring_index(tail, " ", 1)


def parse_structured(text) -> Column:
    """The pairs of a structured line as a map.

    `=` inside values is kept; a repeated key keeps its last value; values with
    spaces are cut there, since the writer does not escape them.
    """
    parts = F.filter(F.split(names.col(text), " "), lambda p: F.instr(p, "=") > 1)
    keys = F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, "=", 1)))
    padded = _padded(text)
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k, _value_after(padded, F.concat(F.lit(" "), k, F.lit("=")))))
    )


def structured_value(text, key: str) -> Column:
    """One value of a structured line: the same as in `parse_structured`, at a fraction of its cost."""
    padded = _padded(text)
    return F.when(padded.contains(f" {key}="), _value_after(padded, F.lit(f" {key}=")))


def structured_part(line) -> Column:
    """What follows STRUCTURED: in a log line (also when the line is indented), null for other lines."""
    padded = _padded(line)
    return F.when(padded.contains(" STRUCTURED: "), F.substring_index(padded, " STRUCTURED: ", -1))


RX_ATTEMPTS = "There have been ([0-9]+) attempts to (send the volume|fetch wal file) (\\S+) so far"


def attempts(line) -> Column:
    """struct(n, what, object) of a retry message, null for other lines."""
    c = names.col(line)
    return F.when(
        c.rlike(RX_ATTEMPTS),
        F.struct(
            F.regexp_extract(c, RX_ATTEMPTS, 1).cast("int").alias("n"),
            F.regexp_extract(c, RX_ATTEMPTS, 2).alias("what"),
            F.regexp_extract(c, RX_ATTEMPTS, 3).alias("object"),
        ),
    )
