"""Versions of the anatomy graph, and entities brought up to date after a patch without deriving all of them again.

What names a sentence holds depends on the names that occur in it and on no others. So after a
patch only reports with a sentence in which a name stands that was added, removed or changed are
derived again; the entities of all others stay as they are. Finding those reports is one walk
along each sentence for the few changed names.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dictionaries import DEFAULT, MOST, Dictionaries
from tessera.functions.automaton import with_places
from tessera.operators.entities import entities, sentences
from tessera.scratch import stored

GRAPH = "keyword string, position string, path string, depth int, lo double, hi double"


class Versions:
    """A folder of graphs, one subfolder a version; a version counts once Spark has marked it as written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        at = make(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def read(self, number: int | None = None, dicts: Dictionaries = DEFAULT) -> Dictionaries:
        """dicts with the graph of a version, the last one if none is named."""
        have = self.numbers()
        if not have or (number is not None and number not in have):
            raise ValueError(f"no version {number or ''} in {self.path}")
        rows = self.spark.read.schema(GRAPH).parquet(f"{self.path}/v={have[-1] if number is None else number}").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} rows")
        return replace(dicts, kg=tuple(sorted(tuple(r) for r in rows)))

    def publish(self, dicts: Dictionaries) -> int:
        """Write a graph as the next version. Two writers of one number: the second fails, as the folder exists."""
        have = self.numbers()
        number = have[-1] + 1 if have else 1
        dicts.graph(self.spark).write.mode("error").parquet(f"{self.path}/v={number}")
        return number


def patched(dicts: Dictionaries, aliases: DataFrame, nodes: DataFrame | None = None) -> Dictionaries:
    """dicts plus names for nodes that it has, aliases (candidate, best_path), and new nodes (keyword, path, lo, hi)."""
    known = {}
    for row in dicts.kg:
        known.setdefault(row[2], row)
    add = [(r["candidate"], *known[r["best_path"]][1:]) for r in aliases.select("candidate", "best_path").collect() if r["best_path"] in known]  # patches are small
    for r in nodes.select("keyword", "path", "lo", "hi").collect() if nodes is not None else ():
        add.append((r["keyword"], r["path"].split(">")[-1], r["path"], r["path"].count(">") + 1, r["lo"], r["hi"]))
    return replace(dicts, kg=tuple(dict.fromkeys([*dicts.kg, *add])))


def changed_names(old: Dictionaries, new: Dictionaries) -> list[str]:
    """Names of which a row was added or removed."""
    return sorted({r[0] for r in set(old.kg) ^ set(new.kg)})


def touched(reports: DataFrame, fields: tuple[str, ...], names: list[str]) -> DataFrame:
    """(report_id) of the reports in which one of the names stands."""
    if not names:
        return reports.select("report_id").limit(0)
    return with_places(sentences(reports, fields), names, first_only=True).select("report_id").distinct()


def refreshed(reports: DataFrame, ents: DataFrame, old: Dictionaries, new: Dictionaries, fields: tuple[str, ...] = ("description", "conclusion")) -> tuple[DataFrame, int]:
    """The entities of the reports by the new graph, and how many reports were derived again. ents: those by the old graph."""
    again = stored(touched(reports, fields, changed_names(old, new)))
    fresh = entities(reports.join(again, "report_id", "left_semi"), fields, new)
    return ents.join(again, "report_id", "left_anti").unionByName(fresh.select(*ents.columns)), again.count()
