"""Small dictionaries of our own: an anatomy graph, rule tables, lexicons, report phrases."""

from __future__ import annotations

#: Root-to-node path, synonyms of the last node, start and end on the body axis.
KG = (
    ("头部", "", 100.0, 150.0),
    ("头部>颅脑", "头颅", 110.0, 150.0),
    ("头部>颅脑>额叶", "", 110.0, 120.0),
    ("头部>颅脑>颞叶", "", 120.0, 130.0),
    ("头部>颅脑>基底节", "基底节区", 125.0, 135.0),
    ("颈部", "", 200.0, 230.0),
    ("颈部>甲状腺", "", 210.0, 220.0),
    ("胸部", "", 300.0, 400.0),
    ("胸部>肺", "", 310.0, 370.0),
    ("胸部>肺>肺上叶", "上肺", 310.0, 340.0),
    ("胸部>肺>肺下叶", "下肺", 340.0, 370.0),
    ("胸部>纵隔", "", 310.0, 360.0),
    ("胸部>心脏", "心影", 340.0, 370.0),
    ("胸部>胸腔", "", 310.0, 380.0),
    ("胸部>乳腺", "", 330.0, 350.0),
    ("腹部", "", 400.0, 500.0),
    ("腹部>肝脏", "肝", 400.0, 430.0),
    ("腹部>肝脏>肝右叶", "", 400.0, 430.0),
    ("腹部>胆囊", "", 415.0, 430.0),
    ("腹部>脾脏", "脾", 405.0, 425.0),
    ("腹部>胰腺", "", 420.0, 435.0),
    ("腹部>肾脏", "肾", 430.0, 460.0),
    ("盆腔", "", 500.0, 600.0),
    ("盆腔>子宫", "", 520.0, 560.0),
    ("盆腔>卵巢", "附件区", 520.0, 550.0),
    ("盆腔>前列腺", "", 550.0, 580.0),
    ("盆腔>膀胱", "", 530.0, 560.0),
    ("脊柱", "", 200.0, 520.0),
    ("脊柱>腰椎", "", 430.0, 500.0),
    ("下肢", "", 600.0, 900.0),
    ("下肢>膝关节", "", 740.0, 760.0),
)

#: Wording of orders.
EXAM = ("胸部平扫", "上腹部增强", "头颅平扫+DWI", "腰椎平扫", "盆腔增强", "双侧乳腺", "前列腺平扫", "左侧膝关节", "右侧膝关节", "甲状腺灌注")

MODALITIES = ("CT", "MR", "DX", "CR", "DR", "MG", "XA", "NM", "HOLOGIC", "US")

DESCRIPTION = (
    "右肺上叶见结节影，大小约8mm×6mm", "左肺下叶见片状高密度影", "双肺纹理清晰", "肝脏形态规整", "肝右叶见囊性灶，直径约2.5cm",
    "胆囊壁增厚", "左肾见结石，大小约5mm", "右肾积水", "脾脏大小正常", "子宫体积增大", "前列腺增生", "卵巢(左侧)见囊肿约35mm",
    "额叶见片状异常信号影", "甲状腺见低密度结节", "心脏增大，射血分数约45%", "腰椎骨质增生", "左侧膝关节积液", "乳腺致密型，老年改变",
    "双侧胸腔积液约200ml", "增强扫描肝脏动脉期明显强化", "胆囊未见结石", "左肺上叶见肿块约25cm", "基底节区见点状低密度影", "肿块压迫主气管", "病灶与大血管分界不清",
)

CONCLUSION = (
    "右肺上叶结节", "左肺上叶结节", "肝囊肿", "胆囊炎", "左肾结石", "右肾结石", "子宫肌瘤", "前列腺增生", "未见明显异常", "腰椎骨质增生",
    "左侧基底节急性脑梗死", "右侧胸腔气胸", "乳腺BI-RADS 2类", "前列腺PI-RADS 3分", "脾脏正常，建议复查", "卵巢囊肿", "心脏增大", "胆囊结石", "脾脏体积增大",
)

#: Normal ranges: keyword, property, least, most.
NORMAL_MEASURE = (("脾脏", "length", 0.0, 120.0), ("心脏", "percent", 0.5, 0.7), ("卵巢", "length", 0.0, 40.0))

#: Critical values: number, device, conclusion pattern, part, least value, description pattern, category.
CRITICAL = ((1, "CT|MR", "急性脑梗死", "颅脑", 0.0, "", "急性脑梗死"), (2, "CT|DR|MR", "气胸", "胸部", 0.0, "积液|气胸|肺", "气胸"), (3, "CT|MR", "结节", "肺", 20.0, "", "巨大肿块"))

#: Replacement rules: order, pattern, replacement, whether it is a regular expression.
REPLACE = ((1, "上肺", "肺上叶", False), (2, "下肺", "肺下叶", False), (3, "约(\\d)", "$1", True), (4, "心影", "心脏", False))

#: Patterns of wrong wording, what to write instead (none: look at the punctuation), and their kind. Back-references
#: are spelt out, so that every engine can run them.
TYPO_RULES = (
    ("肺文里", "肺纹理", "形近字错误"), ("低密渡", "低密度", "形近字错误"), ("高密渡", "高密度", "形近字错误"), ("曾强", "增强", "形近字错误"), ("末见", "未见", "形近字错误"),
    ("支气管[^，,；;。]*?严", "支气管炎症", "音近字"), ("钙化造", "钙化灶", "术语错字"), ("占位性炳变", "占位性病变", "术语错字"),
    ("[^，,；;。\\s]\\n[^，,；;。\\s]", "检查标点", "换行缺少标点"), ("，，+|,,+|；；+|;;+|。。+", "，", "重复标点"),
)

#: Words of a segmenter's dictionary, beside the graph's names.
WORDS = (
    "结节", "肿块", "纹理", "密度", "高密度", "低密度", "异常", "未见", "明显", "体积增大", "骨质增生", "明显强化", "片状", "囊性", "点状", "清晰", "规整", "大小", "直径",
    "增厚", "结石", "积水", "积液", "正常", "增生", "囊肿", "信号", "强化", "老年", "增强", "扫描", "动脉期", "肌瘤", "急性", "脑梗死", "气胸", "复查", "建议", "骨质", "体积", "仁济堂医院", "节石",
)

#: General language: word, frequency, part of speech.
GENERAL = (("文里", 5000, "n"), ("节节", 3000, "d"), ("异常", 8000, "n"), ("仁济堂", 4000, "nz"), ("请赴", 6000, "v"), ("正常", 9000, "a"), ("片状", 20, "n"))
#: Endings of institutions, and letters that never join a run of single ones.
SUFFIXES = ("医院", "中心", "诊所", "公司")
BLOCKED = "的了和与及在为是"

#: Sounds of characters, of our own small list.
SOUNDS = tuple((x[0], x[1:]) for x in (
    "结jie 节jie 石shi 文wen 纹wen 里li 理li 密mi 度du 渡du 末mo 未wei 见jian 异yi 常chang 明ming 显xian 骨gu 质zhi 增zeng 生sheng 强qiang 化hua 高gao 低di 囊nang 肿zhong 性xing "
    "点dian 状zhuang 片pian 积ji 液ye 水shui 信xin 号hao 扫sao 描miao 肌ji 瘤liu 急ji 气qi 胸xiong 复fu 查cha 建jian 议yi 体ti 大da 小xiao 直zhi 径jing 清qing 晰xi 正zheng 肝gan 肺fei 右you 左zuo 胆dan 肾shen"
).split())

#: Model verdicts on findings: candidate, valid, confidence, reason; valid is null where the call failed.
VERDICTS = ((1, True, 0.92, "ok"), (2, True, 0.61, "weak"), (3, False, 0.88, "not a conflict"), (4, True, 0.31, "unsure"), (5, None, None, "timeout"), (6, True, 0.70, "edge"), (7, True, 0.50, "edge"))

def sql_list(rows) -> str:
    """Rows as a VALUES list of standard SQL."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, float):
            return f"CAST({x} AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def kg_rows() -> list[tuple[str, str, str, int, float, float]]:
    """(alias, canonical, path, depth, lo, hi): a row for each name of each node."""
    out = []
    for path, names, lo, hi in KG:
        last = path.split(">")[-1]
        for alias in (last, *(n for n in names.split("|") if n)):
            out.append((alias, last, path, path.count(">") + 1, lo, hi))
    return out


def alternatives() -> str:
    """All names as one alternation, the longest first, so that the first alternative that fits is the longest."""
    return "|".join(sorted({r[0] for r in kg_rows()}, key=lambda a: (-len(a), a)))
