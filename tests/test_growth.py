"""Refreshed entities are those of a full derivation, and few reports are read for them."""

from dataclasses import replace

import pytest

from tessera.dictionaries import DEFAULT
from tessera.operators import growth
from tessera.operators.entities import entities
from tessera.sources.reports import synthetic_reports

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(map(repr, r)) for r in df.select("report_id", "field", "sentence_index", "match_no", "keyword", "start", "path", "orientation", "positive", "attribute").collect())


@pytest.mark.parametrize("late", [("胆囊",), ("肺上叶", "头颅", "左肾"), ()])
def test_refreshed(spark, late):
    reports = synthetic_reports(spark, SF)
    old = replace(DEFAULT, kg=tuple(r for r in DEFAULT.kg if r[0] not in late))
    full = entities(reports)
    out, again = growth.refreshed(reports, entities(reports, dicts=old), old, DEFAULT)
    assert rows(out) == rows(full)
    with_name = sum(any(n in r["ReportStr"] + "|" + r["ConclusionStr"] for n in growth.changed_names(old, DEFAULT)) for r in reports.collect())
    assert again == with_name < reports.count()
    back, _ = growth.refreshed(reports, full, DEFAULT, old)  # names that go, too
    assert rows(back) == rows(entities(reports, dicts=old))


def test_versions(spark, tmp_path):
    kept = growth.Versions(spark, str(tmp_path / "graph"))
    assert kept.numbers() == []
    with pytest.raises(ValueError):
        kept.read()
    assert kept.publish(DEFAULT) == 1
    path = DEFAULT.kg[0][2]
    patch = growth.patched(DEFAULT, spark.createDataFrame([("新名", path), ("无处", "没有")], "candidate string, best_path string"), spark.createDataFrame([("新点", f"{path}>新点", 1.0, 2.0)], "keyword string, path string, lo double, hi double"))
    assert growth.changed_names(DEFAULT, patch) == ["新名", "新点"]
    assert kept.publish(patch) == 2 and kept.numbers() == [1, 2]
    assert set(kept.read().kg) == set(patch.kg) and set(kept.read(1).kg) == set(DEFAULT.kg)
    (tmp_path / "graph" / "v=3").mkdir()  # a write that failed
    assert kept.numbers() == [1, 2]
