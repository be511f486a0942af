"""Lexicons and limits as plain values; operators take them as part of ``dictionaries.Dictionaries``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Word lists and patterns of the rules, free of look-around so that every engine can run them.

    Fixed values where a list is one that results depend on; where the original pattern needs look-around, the
    list is a shorter one of our own. ``dictionaries.read_lexicon_ini`` replaces any of them.
    """

    sentence_end: str = "[。；？;！!\n\r]+"
    clause_end: str = "[，,；;]"
    male: str = "前列腺|精囊|阴囊|睾丸|阴茎|男童"
    female: str = "子宫|卵巢|输卵管|阴道|前庭大腺|女性附件|女童"
    check_modality: str = "CT|MR|DR|DX|MG"
    enhance_order: str = "冠状动脉|冠脉|CTA|CTPA|动脉|门脉|门静脉|增强|静脉|心脏|CTE|血管壁|灌注|CTU|造影"
    enhance_text: str = "增强|强化|动脉期|实质期|延迟期|肝胆期|门脉期|静脉期"
    enhance_excuse: str = "建议|纹理增强|必要|请|^完善"
    diffusion: str = "弥散|扩散|张量|DWI|B值"
    susceptibility: str = "SWI|磁敏感|含铁血黄素|微出血"
    perfusion: str = "灌注|CBF|CBV|MTT|TTP|perfusion"
    spectroscopy: str = "波普|波谱|频谱|频普|MRS|Cho|NAA|Glx|Lac|氨酸|乳酸|肌酸|胆碱|肌醇"
    single_organ: str = "盆腔|椎体|脑干|子宫|前列腺|胃|脾|胰腺|垂体|腹部|胆总管"
    paired_organ: str = "额叶|顶叶|枕叶|颞叶|丘脑|小脑半球|耳|眼眶|肾脏|输尿管|下肢|上肢|乳房|颈内动脉|髋关节|髋肌|髂动脉|颈外动脉|椎动脉|锁骨下动脉|颈总动脉|大脑前动脉|大脑中动脉|大脑后动脉|鼻腔|肋膈角|肋骨|膈|胸腔"
    ignore_entity: str = "(随访|复查|检查)(除外|排除)|新生儿|早产儿|【注|术毕|敷料|缘平面以[上下]"
    ignore_sentence: str = "^(余|其余|残|若)|临时|换|结合临床|进一步|建议|随访|必要|请|fs$|sag$|cor$|tra$|显示欠佳$|所见$|余部|余段|片示$|准备|隐匿性骨折|骨折端未分离移位|【注"
    deny: str = "未见|无|脂肪|多囊|未|压迫|累及|侵犯|推|沿|半包绕|包绕|遮盖|紧贴|近|未达|尖端|较|仅|平约|病变位于|发自|向|临近|邻近"
    skip_part: str = "手术"
    skip_apply: str = "骨龄"
    absolute_illness: str = "未见|硬化|缺如|缺失"
    illness: str = "不对称|不均|不通|不清|欠清|窄|囊|结节|点状|条状|片状|肿大|增大|增厚|积液|积水|结石|增生|肌瘤|炎|梗死|气胸|占位|高密度|低密度|异常信号影"
    normal: str = "清晰|清楚|规整|通畅|完整|对称|光滑|自然|正常|如常|良好|未见|无"
    physiologic: str = "老年|生理|闭合|优势|致密型|新生儿|早产儿"
    miss_ignore: str = "^位于|伪影|插管|气化|^局部|^邻近|腰化|骶化|置管"
    critical_ignore: str = "相仿|吸收|同前|大致|好转|减轻|减少|缩小|减小|变低|相似|未见|无|术后|慢性|陈旧|改善|缓解|消失"
    nonstandard: str = "肝岛叶|脑尾叶|肝右下叶|肝左下叶|肝右上叶|肝左上叶|左侧甲状腺|右侧甲状腺|左肺下叶前基底段|左肺下叶内基底段|左肺上叶尖段|左肺上叶后段|右下肝|右上肝|左下肝|左上肝|下颚下腺|颈静脉鞘|冒状腱膜|基地段|右肺上叶尖后段|伪音|侧脑室压部|侧脑室膝部|附件甲状腺|附件肝|附件左肾|附件右肾|上叶[前|内|后|前内|外]基底段|声影|回声|左肺上叶背段|碟鞍|腹壁血栓|临近|椎间盘凸出"
    nonstandard_ct: str = "信号"
    nonstandard_mr: str = "密度"
    mm_max: float = 340.0
    cm_max: float = 20.0
    m_max: float = 0.02
    key_part: str = "胆囊|肝脏|脾脏|子宫|鼻窦|心脏|肾脏|胰腺|膀胱|阑尾|胸腔|胸廓|腋窝|肋骨|结肠|直肠|小肠|食道|丘脑|基底节|输尿管"
    sub_part: str = "近段|中段|远段|近端|远端|起始段"
    filler: str = "左侧|右侧|双侧|及|区| |左|右|伴|和|并|示|所见|影|拟|考虑|可能|可见|呈"
    alike: float = 0.78
    contradiction_exclude: str = "位于|低于|吸收|消失|引流|支架|发育|副|复查"


LEXICON = Lexicon()

#: Aspects of a finding, in order.
ASPECTS = (
    ("aspect1", "形态|形状|轮廓|边缘|不规则|结构|表面|切除|硬化"),
    ("aspect2", "位置|升高|降低|偏|左移|右移|移动|上移|下移|前移|后移|移位|游走|居中|对称|轴正常|轴左|轴右|切除"),
    ("aspect3", "大小|增大|缩小|萎缩|肥大|扩大|肿大|饱满|体积|增粗|扩张|肿胀|增宽"),
    ("aspect4", "增强|强化|动脉期|实质期|延迟期|门脉期|静脉期"),
    ("aspect5", "积液|积水"),
    ("aspect6", "积气|气体"),
    ("aspect7", "增厚"),
    ("aspect8", "密度|致密|高密|低密|信号|息肉|囊肿|充盈缺损|脂肪|钙化"),
    ("aspect9", "骨质|实质"),
    ("aspect10", "大淋巴结|淋巴结肿大|淋巴结增大"),
    ("aspect11", "结石|T管|PICC|引流管|起搏器|插管|导管|尿管|胃管|过滤器|支架"),
)

#: Report complexity by modality, and the score bands of an audit.
COMPLEXITY = {"DR": 0.1, "MG": 0.1, "CT": 0.2, "MR": 0.3}
GRADES = (("A", 90), ("B", 60), ("C", 0))
AUDIT_POINTS = {"part": 20, "conclusion": 20, "report": 20, "language": 20, "terms": 10, "audit": 10}
