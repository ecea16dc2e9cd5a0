"""Tables as SQL scripts of INSERT statements (S-23): a splittable reader and a writer.

A script cannot be cut at line ends alone, since a value may hold quotes, line ends, semicolons and what looks like a
comment. The reader lets Spark cut the file into blocks of whole lines and settles each block's beginning first:

1. every block is scanned once for each state it might begin in (plain text, inside one of three kinds of quotes, inside
   a block comment); the result is a row per block: the state and parenthesis depth that each beginning leads to;
2. from the file's start these rows give every block its true beginning. A second scan returns, per block, the text before
   its first closing parenthesis, the text after its last one, and its last INSERT header: one partial record per block
   that the driver joins to the next block's;
3. each block is parsed with what it continues, so that a record cut by blocks is read once, by the block that ends it.

What reaches the driver is a few short values per file block (128 MB), not rows. Records are kept in the order of the file
only within a block.

Read: ``INSERT INTO name (columns) VALUES (...), (...);`` with or without a column list, names in backquotes or double
quotes; numbers, quoted text with doubled quotes and backslash escapes, NULL, TRUE and FALSE; other unquoted values stay
as text. Statements of any other kind are passed over. Cases: an empty file or one without the table gives no rows; a
column that a statement leaves out is NULL; a record with more or fewer values than columns is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.sources.schemas import TABLES
from lendwise.sources.tables import typed

PLAIN, COMMENT, QUOTES = "", "/*", ("'", '"', "`")
MODES = (PLAIN, *QUOTES, COMMENT)
_NEXT = re.compile(r"""['"`()]|/\*|--(?=\s|$)|\#""")
_STOP = {"'": re.compile(r"\\.|''|'", re.S), '"': re.compile(r'\\.|""|"', re.S), "`": re.compile("``|`"), COMMENT: re.compile(r"\*/")}
_HEADER = re.compile(r"""INSERT\s+(?:IGNORE\s+)?INTO\s+[`"]?(\w+)[`"]?\s*$""", re.I)
_VALUES = re.compile(r"VALUES\s*$", re.I)
_DIRECT = re.compile(r"""INSERT\s+(?:IGNORE\s+)?INTO\s+[`"]?(\w+)[`"]?\s+VALUES\s*$""", re.I)
_VALUE = re.compile(r"""\s*(?:'((?:[^'\\]|\\.|'')*)'|"((?:[^"\\]|\\.|"")*)"|([^,'"]*?))\s*(?:,|$)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}  # fixed values: backslash escapes


class Scanner:
    """Reads lines from a given state. ``ended`` gets the text of each record: what stands before a parenthesis that is
    opened at depth 0, that parenthesis, and all up to the one that closes it. Comments are dropped."""

    def __init__(self, mode: str = PLAIN, depth: int = 0, text: str = ""):
        self.mode, self.depth, self.parts = mode, depth, [text] if text else []

    def line(self, text: str) -> Iterator[str]:
        at = 0
        while True:
            if self.mode == PLAIN:
                found = _NEXT.search(text, at)
                if not found:
                    self.parts.append(text[at:] + "\n")
                    return
                sign = found[0]
                if sign in ("--", "#"):  # to the end of the line
                    self.parts.append(text[at:found.start()] + "\n")
                    return
                if sign == COMMENT:
                    self.parts.append(text[at:found.start()] + " ")
                    self.mode = COMMENT
                else:
                    self.parts.append(text[at:found.end()])
                    if sign in QUOTES:
                        self.mode = sign
                    else:
                        self.depth += 1 if sign == "(" else -1
                at = found.end()
                if sign == ")" and self.depth == 0:
                    yield "".join(self.parts)
                    self.parts = []
            else:
                found = _STOP[self.mode].search(text, at)
                while found and len(found[0]) == 2 and self.mode != COMMENT:  # an escape or a doubled quote
                    found = _STOP[self.mode].search(text, found.end())
                end = found.end() if found else len(text)
                if self.mode != COMMENT:
                    self.parts.append(text[at:end] + ("" if found else "\n"))
                if not found:
                    return
                self.mode, at = PLAIN, end

    @property
    def rest(self) -> str:
        return "".join(self.parts)


def _split(record: str) -> tuple[str, str]:
    """(text before the opening parenthesis, text inside). The opening one is the first outside quotes."""
    found = _NEXT.search(record)
    while found[0] != "(":
        at = _end_of_quote(record, found[0], found.end()) if found[0] in QUOTES else found.end()
        found = _NEXT.search(record, at)
    return record[:found.start()], record[found.end():-1]


def _end_of_quote(text: str, quote: str, at: int) -> int:
    found = _STOP[quote].search(text, at)
    while found and len(found[0]) == 2:
        found = _STOP[quote].search(text, found.end())
    return found.end() if found else len(text)


def values_of(inside: str) -> list[str | None]:
    """The values of a record as text; NULL is None."""
    out, at = [], 0
    while True:
        m = _VALUE.match(inside, at)
        if not m:
            raise ValueError(f"not a list of values: {inside[at:at + 60]!r}")
        if m[3] is None:
            quote = "'" if m[1] is not None else '"'
            body = m[1] if m[1] is not None else m[2]
            out.append(re.sub(rf"\\(.)|{quote}{quote}", lambda e: _ESCAPES.get(e[1], e[1]) if e[1] else quote, body, flags=re.S))
        else:
            word = m[3]
            out.append(None if word.upper() == "NULL" else {"TRUE": "1", "FALSE": "0"}.get(word.upper(), word))
        at = m.end()
        if not m[0].endswith(",") or at > len(inside):
            return out


class Records:
    """Follows the records of a script: which statement a record belongs to. Without a context (a block whose beginning is
    not settled yet) ``waiting`` notes what came before the first statement that starts inside."""

    def __init__(self, context: tuple[str, tuple[str, ...], bool] | None = ("", (), False)):
        self.context, self.waiting = context, ""

    def __call__(self, record: str) -> list[str | None] | None:
        """The values of a record of an INSERT statement; None for a header or anything else."""
        before, inside = _split(record)
        before = before.split(";")[-1]
        if header := _HEADER.search(before):
            names = tuple(c.strip().strip('`"').lower() for c in inside.split(","))
            self.context = (header[1].lower(), names, False)
            return None
        if direct := _DIRECT.search(before):
            self.context = (direct[1].lower(), (), True)
        elif _VALUES.search(before):
            self.follows("v")
        elif before.strip() == ",":
            self.follows(",")
        else:
            self.context = ("", (), False)
        return values_of(inside) if self.context and self.context[2] else None

    def follows(self, kinds: str) -> None:
        """VALUES ('v') after a header opens its list, a comma (',') goes on with an open one; else no INSERT goes on."""
        for kind in kinds:
            if self.context is None:
                self.waiting += kind if kind not in self.waiting else ""
                continue
            table, columns, live = self.context
            self.context = (table, columns, True) if table and (live or kind == "v") else ("", (), False)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): the lines of a block follow each other in one task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The blocks of a task with their lines."""
    rows = ((f, b, v) for batch in batches for f, b, v in zip(*(c.to_pylist() for c in batch.columns)))
    for (file, block), group in groupby(rows, key=lambda r: r[:2]):
        yield file, block, (v for _, _, v in group)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, lines in _blocks(batches):
        scans = [Scanner(m) for m in MODES]
        for line in lines:
            for s in scans:
                for _ in s.line(line):
                    pass
                s.parts = []
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "modes": [[s.mode for s in scans]],
                                          "depths": [[s.depth for s in scans]]})


def load_script(spark: SparkSession, table: str, path: str, quarantine: str | None = None) -> DataFrame:
    """The rows that the script (or scripts) at ``path`` inserts into ``table``, in its declared types. A value that does
    not convert goes to ``quarantine`` with its row, or raises."""
    lines = _lines(spark, path)
    begins: dict[tuple[str, int], tuple[str, int]] = {}
    states = lines.mapInArrow(_states, "file string, block long, modes array<string>, depths array<long>").collect()
    file, mode, depth = None, PLAIN, 0
    for r in sorted(states, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, mode, depth = r["file"], PLAIN, 0
        begins[r["file"], r["block"]] = (mode, depth)
        at = MODES.index(mode)
        mode, depth = r["modes"][at], depth + r["depths"][at]

    def ends(batches):
        for file, block, lines in _blocks(batches):
            scan, follow, first = Scanner(*begins[file, block]), Records(None), None
            for line in lines:
                for record in scan.line(line):
                    if first is None:
                        first = record
                    else:
                        follow(record)
            known = follow.context or ("", (), False)
            yield pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "first": pa.array([first], pa.string()), "rest": [scan.rest],
                 "known": [follow.context is not None], "waiting": [follow.waiting], "table": [known[0]],
                 "columns": pa.array([list(known[1])], pa.list_(pa.string())), "live": [known[2]]})

    kind = ("file string, block long, first string, rest string, known boolean, waiting string, table string, "
            "columns array<string>, live boolean")
    carried: dict[tuple[str, int], tuple[str, tuple]] = {}
    file, text, follow = None, "", Records()
    for r in sorted(lines.mapInArrow(ends, kind).collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, text, follow = r["file"], "", Records()
        carried[r["file"], r["block"]] = (text, follow.context)
        if r["first"] is None:
            text += r["rest"]
            continue
        follow(text + r["first"])
        follow.follows(r["waiting"])
        if r["known"]:
            follow.context = (r["table"], tuple(r["columns"]), r["live"])
        text = r["rest"]

    names = tuple(c.name for c in TABLES[table].columns)

    def parse(batches):
        for file, block, lines in _blocks(batches):
            text, context = carried[file, block]
            scan, follow = Scanner(*begins[file, block], text), Records(context)
            made: list[list[str | None]] = []
            for line in lines:
                for record in scan.line(line):
                    values = follow(record)
                    if values is None or follow.context[0] != table:
                        continue
                    columns = follow.context[1] or names
                    if len(values) != len(columns):
                        raise ValueError(f"{len(values)} values for {len(columns)} columns of {table}: {record[:80]!r}")
                    row = dict(zip(columns, values))
                    made.append([row.get(c) for c in names])
                    if len(made) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=list(names))
                        made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=list(names))

    raw = lines.mapInArrow(parse, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return typed(raw, table, quarantine=quarantine)


def _quoted(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("'", "''")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit("'"), c, F.lit("'"))


def write_script(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> None:
    """Writes rows of ``table`` as a folder of scripts, one INSERT statement per row; no task needs another's rows."""
    names = [c.name for c in TABLES[table].columns]
    numbers = ("bigint", "int", "decimal(8,2)")
    values = [F.coalesce(F.col(c.name).cast("string") if c.dtype.simpleString() in numbers else _quoted(F.col(c.name).cast("string")),
                         F.lit("NULL")) for c in TABLES[table].columns]
    line = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(names)}) VALUES ("), F.concat_ws(", ", *values), F.lit(");"))
    df.select(line.alias("value")).write.mode(mode).text(path)
