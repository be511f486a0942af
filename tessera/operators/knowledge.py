"""The anatomy graph: paths, axis ranges, aliases, candidate mining, retrieval, validation, patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.dictionaries import DEFAULT, Dictionaries
from tessera.operators.corpus import char_ngrams
from tessera.operators.entities import graph, name_hits
from tessera.scratch import stored

#: What a candidate must not be.
STOP_WORDS = (
    "患者", "检查", "结果", "所示", "未见", "显示", "考虑", "建议", "请", "结合", "临床", "诊断", "扫描", "图像", "层面", "范围", "情况", "表现", "指出", "提示", "可见", "可见于", "明显", "轻度", "重度",
    "部分", "局部", "区域", "周围", "邻近", "前方", "后方", "上方", "下方", "右侧", "左侧", "双侧", "两侧", "以上", "以下", "以内", "以外", "毫米", "厘米", "mm", "cm", "ml", "HU", "ms", "大小约", "直径约",
    "对比剂", "造影剂", "增强扫描", "平扫", "复查", "随访", "进一步",
)
#: Marks that a candidate doesn't hold, and patterns of which it fits one.
MARKS = "[，。；：！？、\"（）【】《》]"
ANATOMY = "[左右上下前后内外侧中]?(?:叶|段|区|室|腔|窝|间隙|裂|沟|回|角|体|头|颈|脚|突|弓|根|干|支|面|缘|壁|膜|带|核|节|丛)|[左右]?[上下]?[前后]?第?[一二三四五六七八九十0-9]+[节段肋椎]|[左右]?[上下]?[前后]?[IVX0-9]+[节段]|[左右]?[腰胸颈骶][0-9-]+(?:椎体|椎间盘|椎间隙|椎管)|[左右]?[一二三四五六][一二三四五六七八九十]指肠|[左右]?[上下]肢"
#: Patterns that catch a part by what stands around it, and their names.
CONTEXTS = ("位于([\\u4e00-\\u9fa5]{2,8})(?:内|处|边缘|周围|邻近)", "(?:压迫|推移|侵犯|累及|包绕|包埋)([\\u4e00-\\u9fa5]{2,8})", "(?:与|和|同)([\\u4e00-\\u9fa5]{2,8})(?:分界|界限|边界|相邻)", "(?:自|从|由)([\\u4e00-\\u9fa5]{2,8})(?:起源|发出|延伸|延续)")
METHODS = ("location_pattern", "action_pattern", "relation_pattern", "origin_pattern")


def prefixes(spark: SparkSession) -> DataFrame:
    """(keyword, lo, hi, level, node): every node on the way to each name."""
    g = graph(spark).select("keyword", "lo", "hi", F.split("path", ">").alias("nodes"))
    return g.select("keyword", "lo", "hi", F.posexplode("nodes").alias("level", "node"))


def parent_axis(spark: SparkSession) -> DataFrame:
    """(level, node, lo, hi): the range that a node's descendants span."""
    return prefixes(spark).groupBy("level", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def alias_map(spark: SparkSession) -> DataFrame:
    """(keyword, paths, n_paths): the paths of each name, in order."""
    return graph(spark).groupBy("keyword").agg(F.array_join(F.array_sort(F.collect_set("path")), "；").alias("paths"), F.count_distinct("path").alias("n_paths"))


def root_paths(spark: SparkSession) -> DataFrame:
    """(path): all distinct paths from a root to any node."""
    g = graph(spark).select(F.split("path", ">").alias("n"))
    steps = F.transform(F.sequence(F.lit(1), F.size("n")), lambda k: F.array_join(F.slice("n", F.lit(1), k), ">"))
    return g.select(F.explode(steps).alias("path")).distinct()


def graph_index(spark: SparkSession) -> DataFrame:
    """(node_id, canonical, level_path, depth, n_aliases): a row for each node."""
    return graph(spark).groupBy(F.md5("path").alias("node_id"), F.col("position").alias("canonical"), F.col("path").alias("level_path"), "depth").agg((F.count("*") - 1).alias("n_aliases"))


def substrings(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    """rows plus part: all distinct runs of characters of a short text."""
    t = F.col(text)
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    every = F.flatten(F.transform(F.sequence(F.lit(least), F.length(t)), of))
    return rows.where(F.length(t) >= least).select("*", F.explode(F.array_distinct(every)).alias("part"))


def retrieve(spark: SparkSession, candidates: DataFrame, k: int = 5, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(candidate, path, score, rank): nodes by exact name, synonym, then containment either way.

    Containment is an equality with the runs of characters of the shorter side, so nothing is compared with everything.
    """
    g = graph(spark, dicts).select("keyword", "position", "path").distinct()
    c = candidates.select("candidate").distinct()
    inside = substrings(c, "candidate").join(F.broadcast(g), F.col("part") == F.col("keyword")).drop("part")
    around = c.join(substrings(g, "keyword"), F.col("candidate") == F.col("part")).drop("part")
    canon, same = F.col("keyword") == F.col("position"), F.col("candidate") == F.col("keyword")
    score = F.when(canon & same, 1.0).when(same, 0.95).when(canon, 0.8).otherwise(0.7)
    best = inside.unionByName(around).groupBy("candidate", "path").agg(F.max(score).alias("score"))
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unknown(candidates: DataFrame, spark: SparkSession, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """candidates (candidate, …) that hold no known name and are part of none."""
    held = name_hits(candidates.select("candidate"), dicts.names(), "candidate").select("candidate").distinct()
    parts = substrings(graph(spark, dicts).select("keyword").distinct(), "keyword").select(F.col("part").alias("candidate")).distinct()
    return candidates.join(held, "candidate", "left_anti").join(parts, "candidate", "left_anti")


def possible(gram: Column) -> Column:
    """Whether a run of characters may be a part: an ideograph, no mark, no stop word, and more than two if all are letters."""
    letters = gram.rlike("^[A-Za-z\\u4e00-\\u9fff]{1,2}$")
    return gram.rlike("[\\u4e00-\\u9fff]") & ~letters & ~gram.isin(*STOP_WORDS) & ~gram.rlike(MARKS)


def mentions(rows: DataFrame, least: int = 2, most: int = 8, text: str = "sentence") -> DataFrame:
    """rows plus (candidate, method): runs of characters that look like a part, and what the context patterns catch."""
    rows = rows.where(F.length(F.trim(text)) >= 5)
    grams = char_ngrams(rows, least, most, text).withColumnRenamed("gram", "candidate").withColumn("method", F.lit("ngram"))
    grams = grams.where(possible(F.col("candidate")) & F.col("candidate").rlike(ANATOMY))
    found = [rows.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))).alias("candidate"), F.lit(m).alias("method")) for p, m in zip(CONTEXTS, METHODS, strict=True)]
    return reduce(DataFrame.unionByName, found, grams)


def different(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """(sentence, times, first): each different text once, how often it occurs and where first.

    rows: (report_id, field, sentence_index, sentence). Only counts and least ids are kept for a place, so that Spark
    aggregates by hash; what is looked for in the texts afterwards costs by different texts.
    """
    placed = rows.groupBy(text, "field", "sentence_index").agg(F.count("*").alias("times"), F.min("report_id").alias("report_id"))
    first = F.min(F.struct("report_id", "field", "sentence_index")).alias("first")
    return placed.groupBy(text).agg(F.sum("times").alias("times"), first)


def frequent(rows: DataFrame, min_frequency: int = 3, text: str = "sentence") -> DataFrame:
    """(candidate, frequency, first): mentions that are frequent, with report, field, place, sentence and method of the first.

    rows: (report_id, field, sentence_index, sentence).
    """
    at = F.struct("first.report_id", "first.field", "first.sentence_index", F.col(text).alias("sentence"), "method")
    counted = mentions(stored(different(rows, text)), text=text).groupBy("candidate").agg(F.sum("times").alias("frequency"), F.min(at).alias("first"))
    return counted.where(F.col("frequency") >= min_frequency)


def discover(rows: DataFrame, spark: SparkSession, min_frequency: int = 3, dicts: Dictionaries = DEFAULT, text: str = "sentence") -> DataFrame:
    """(candidate, frequency, method, report_id, sentence): unknown mentions that are frequent, with where they occur first.

    rows: (report_id, field, sentence_index, sentence).
    """
    counted = stored(frequent(rows, min_frequency, text))
    return unknown(counted, spark, dicts).select("candidate", "frequency", "first.method", "first.report_id", "first.sentence")


def context_candidates(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """(candidate, method, frequency): what the context patterns catch."""
    each = rows.groupBy(text).agg(F.count("*").alias("times"))
    return mentions(each, text=text).where("method <> 'ngram'").groupBy("candidate", "method").agg(F.sum("times").alias("frequency"))


def normalised(candidates: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(candidate, frequency, report_id, best_path, n_nodes, confidence, is_alias, is_new): what a candidate stands for, by rule.

    A candidate with nodes is an alias of the best one, as sure as its score; one without may be a new node, the surer
    the more often it occurs. A model's answers can take the place of this table.
    """
    best = retrieved.groupBy("candidate").agg(F.max("score").alias("top"), F.max_by("path", F.struct("score", "path")).alias("best_path"), F.count("*").alias("n_nodes"))
    j = candidates.join(best, "candidate", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
    sure = F.coalesce("top", F.round(F.least(F.lit(0.9), 0.6 + 0.1 * F.log10(F.col("frequency") + 0.0)), 6))
    return j.select("candidate", "frequency", "report_id", "best_path", "n_nodes", sure.alias("confidence"), (F.col("n_nodes") > 0).alias("is_alias"), (F.col("n_nodes") == 0).alias("is_new"))


def validate(rows: DataFrame, reports: DataFrame, spark: SparkSession, least: float = 0.7, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """rows of ``normalised`` plus level: A if graph, confidence and the order's part agree, B without the last, else C.

    reports: (report_id, StudyPart). The part agrees if a node on the best path stands in the order's wording; a new node
    needs none, but has no node to refer to, which the graph test calls a fault below the frequency of a sure one.
    """
    nodes = graph(spark, dicts).select(F.col("path").alias("best_path")).distinct().withColumn("known", F.lit(True))
    j = rows.join(F.broadcast(nodes), "best_path", "left").join(reports.select("report_id", "StudyPart"), "report_id", "left")
    graph_ok = F.col("is_new") | F.coalesce("known", F.lit(False))
    part_ok = F.col("is_new") | F.exists(F.split("best_path", ">"), lambda n: F.contains("StudyPart", n))
    sure = F.col("confidence") >= least
    level = F.when(graph_ok & sure & F.coalesce(part_ok, F.lit(False)), "A").when(graph_ok & sure, "B").otherwise("C")
    return j.select(*rows.columns, level.alias("level"))


def alias_patch(validated: DataFrame, spark: SparkSession, dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(candidate, best_path, level): aliases to add, of levels A and B, that the graph doesn't have yet."""
    have = graph(spark, dicts).select(F.col("keyword").alias("candidate")).distinct()
    return validated.where("is_alias AND level IN ('A', 'B')").join(F.broadcast(have), "candidate", "left_anti").select("candidate", "best_path", "level")


def node_patch(validated: DataFrame) -> DataFrame:
    """(candidate, frequency, level): new nodes of levels A and B, to be looked at."""
    return validated.where("is_new AND level IN ('A', 'B')").select("candidate", "frequency", "level")


def tree_text(spark: SparkSession) -> DataFrame:
    """(root, tree): an indented outline below each root."""
    n = root_paths(spark).select("path", F.split("path", ">").alias("n"))
    line = F.concat(F.repeat(F.lit("  "), F.size("n") - 1), F.lit("- "), F.element_at("n", -1))
    lines = n.select(F.col("n")[0].alias("root"), F.struct("path", line.alias("line")).alias("x"))
    return lines.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("tree"))


def axis_overlaps(spark: SparkSession, most_gap: float = 100.0) -> DataFrame:
    """(a, b): nodes of one root whose axis ranges overlap and start at most ``most_gap`` apart."""
    g = graph(spark).where("keyword = position").select("path", "lo", "hi", F.element_at(F.split("path", ">"), 1).alias("root"))
    a, b = g.select("root", F.col("path").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah")), g.select("root", F.col("path").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    return a.join(b, "root").where((F.col("a") < F.col("b")) & (F.col("al") < F.col("bh")) & (F.col("bl") < F.col("ah")) & (F.abs(F.col("al") - F.col("bl")) <= most_gap)).select("a", "b")
