"""Word lists, lookup tables, thresholds and patterns the results depend on.

They are data, not logic. Every list below is bounded and small enough to travel inside a plan as a literal.
"""

# Characters that count as white space in text processing.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Headings that end the usable part of a document.
CUTOFF_HEADINGS = ["参考文献", "参考资料", "致谢", "Acknowledg?ement[s]?", "References", "BIBLIOGRAPHY", "Bibliography"]

# Words that keep a short line.
DOMAIN_KEYWORDS = [
    "炎", "癌", "综合征", "综合症", "症", "疾病", "病因", "病程", "病理", "病变",
    "诊断", "治疗", "用药", "药物", "方案", "疗法", "干预", "预后", "预防",
    "风险", "危险因素", "并发症", "感染", "出血", "坏死",
    "患者", "病人", "临床", "指南", "推荐", "随访", "复发",
    "胰腺", "胰腺炎", "胰腺癌", "肝", "肾", "心功能",
    "pancreatitis", "pancreas", "acute", "chronic",
    "disease", "syndrome", "disorder",
    "treatment", "therapy", "management",
    "diagnosis", "diagnostic",
    "clinical", "patient", "patients",
    "risk", "factor", "complication", "outcome", "prognosis",
]

# Punctuation counted as noise in the garbage-line ratio.
NOISE_PUNCTUATION = ".,;:[]()%+-=<>/\\|~"

# Entity types.
ENTITY_TYPES = [
    "Disease", "Symptom", "Population", "Medicine", "Prognosis", "PhysicalExamination", "LaboratoryExamination",
    "ImagingExamination", "PathologyExamination", "OtherExamination", "AbnormalExaminationResult", "TCMTreatment",
    "Surgery", "DrugTreatment", "WesternPhysicalTherapy", "OtherTreatment", "AnatomicalSite", "AnatomicalSubstance",
    "MedicalEquipment", "Hospital", "Department", "Gene", "Microorganism", "PhysicalChemicalFactor",
    "PsychologicalBehavior", "Lifestyle", "ImmuneFactor", "DisuseFactor", "ICD10Code", "Synonym",
]

# Relation types.
RELATION_TYPES = [
    "HAS_ABNORMAL_EXAM_RESULT", "EXAM_HAS_ABNORMAL_RESULT", "REQUIRES_EXAM", "TREATED_BY", "PREVENTED_BY",
    "TREATS_COMPLICATION", "HAS_SIDE_EFFECT", "HAS_SYMPTOM", "AFFECTS_POPULATION", "HAS_COMPLICATION",
    "DIFFERENTIAL_DIAGNOSIS", "HAS_ETIOLOGY", "BELONGS_TO_DEPARTMENT", "TREATED_AT_HOSPITAL", "AFFECTS_SITE",
    "HAS_PROGNOSIS", "USES_EQUIPMENT", "BELONGS_TO", "HAS_ICD10_CODE", "HAS_SYNONYM",
]

# Chinese names of entity types.
ENTITY_TYPE_ALIASES = {
    "疾病": "Disease", "症状或体征": "Symptom", "症状": "Symptom", "体征": "Symptom", "群体": "Population",
    "药物": "Medicine", "预后": "Prognosis", "体格检查": "PhysicalExamination", "实验室检查": "LaboratoryExamination",
    "影像学检查": "ImagingExamination", "病理检查": "PathologyExamination", "其它检查": "OtherExamination",
    "其他检查": "OtherExamination", "异常检查结果": "AbnormalExaminationResult", "中医治疗": "TCMTreatment",
    "手术": "Surgery", "药物治疗": "DrugTreatment", "西医理疗": "WesternPhysicalTherapy", "其它治疗": "OtherTreatment",
    "其他治疗": "OtherTreatment", "解剖部位": "AnatomicalSite", "解剖物质": "AnatomicalSubstance",
    "医用设备": "MedicalEquipment", "器械": "MedicalEquipment", "医用设备、器械和材料": "MedicalEquipment",
    "医院": "Hospital", "科室": "Department", "基因": "Gene", "微生物类": "Microorganism", "微生物": "Microorganism",
    "理化因素": "PhysicalChemicalFactor", "心理行为": "PsychologicalBehavior", "生活习惯": "Lifestyle",
    "免疫因素": "ImmuneFactor", "废用性因素": "DisuseFactor", "ICD10编码": "ICD10Code", "ICD10 编码": "ICD10Code",
    "同义词": "Synonym", "别称": "Synonym",
}

# Chinese names of relation types.
RELATION_TYPE_ALIASES = {
    "异常检查结果": "HAS_ABNORMAL_EXAM_RESULT", "用于检查": "REQUIRES_EXAM", "用于治疗": "TREATED_BY",
    "用于预防": "PREVENTED_BY", "治疗并发症": "TREATS_COMPLICATION", "副作用": "HAS_SIDE_EFFECT",
    "症状或体征": "HAS_SYMPTOM", "多发人群": "AFFECTS_POPULATION", "并发症": "HAS_COMPLICATION",
    "鉴别诊断": "DIFFERENTIAL_DIAGNOSIS", "病因": "HAS_ETIOLOGY", "就诊科室": "BELONGS_TO_DEPARTMENT",
    "就诊医院": "TREATED_AT_HOSPITAL", "发病部位": "AFFECTS_SITE", "预后": "HAS_PROGNOSIS", "使用于": "USES_EQUIPMENT",
    "属于": "BELONGS_TO", "ICD10编码": "HAS_ICD10_CODE", "ICD10 编码": "HAS_ICD10_CODE", "别称": "HAS_SYNONYM",
}

# Names that are never entities, and the least length of a name.
NAME_BLACKLIST = [
    "患者", "病人", "患者主诉", "主诉", "今日", "一般情况", "可", "良好",
    "正常", "无", "有", "是", "否", "等", "及", "或", "与", "和",
    "该", "此", "其", "本", "上述", "如下", "例如", "如", "若",
]
NAME_MIN_LENGTH = 2

# Allowed subject and object types per relation type.
_EXAMS = ["PhysicalExamination", "LaboratoryExamination", "ImagingExamination", "PathologyExamination", "OtherExamination"]
_THERAPIES = ["TCMTreatment", "Surgery", "DrugTreatment", "WesternPhysicalTherapy", "OtherTreatment"]
RELATION_RULES = {
    "HAS_SYMPTOM": (["Disease", "Symptom"], ["Symptom"]),
    "HAS_ABNORMAL_EXAM_RESULT": (["Disease"], ["AbnormalExaminationResult"]),
    "EXAM_HAS_ABNORMAL_RESULT": (_EXAMS, ["AbnormalExaminationResult"]),
    "REQUIRES_EXAM": (["Disease", "Symptom"], _EXAMS),
    "TREATED_BY": (["Disease", "Symptom"], ["Medicine"] + _THERAPIES),
    "PREVENTED_BY": (["Disease", "Symptom"], ["Medicine"] + _THERAPIES),
    "TREATS_COMPLICATION": (_THERAPIES, ["Disease"]),
    "HAS_SIDE_EFFECT": (["Medicine"], ["Disease", "Symptom"]),
    "AFFECTS_POPULATION": (["Disease"], ["Population"]),
    "HAS_COMPLICATION": (["Disease"], ["Disease"]),
    "DIFFERENTIAL_DIAGNOSIS": (["Disease"], ["Disease"]),
    "HAS_ETIOLOGY": (
        ["Disease"],
        ["Gene", "Microorganism", "PhysicalChemicalFactor", "PsychologicalBehavior", "Lifestyle", "ImmuneFactor",
         "DisuseFactor", "Disease", "Symptom"],
    ),
    "BELONGS_TO_DEPARTMENT": (["Disease"], ["Department"]),
    "TREATED_AT_HOSPITAL": (["Disease"], ["Hospital"]),
    "AFFECTS_SITE": (["Disease"], ["AnatomicalSite", "AnatomicalSubstance"]),
    "HAS_PROGNOSIS": (["Disease"], ["Prognosis"]),
    "USES_EQUIPMENT": (_EXAMS + _THERAPIES, ["MedicalEquipment"]),
}

# Question types, first match wins.
QUESTION_TYPES = [
    ("what", ["什么是", "什么叫", "啥是", "what is", "what are"]),
    ("how", ["如何", "怎么", "怎样", "how to", "how can"]),
    ("why", ["为什么", "为啥", "why", "原因"]),
    ("which", ["哪个", "哪些", "which", "what"]),
    ("yes_no", ["是否", "有没有", "会不会", "is", "are", "can"]),
]

# Intents of the fine classifier, first match wins.
INTENTS_FINE = [
    ("definition", ["什么是", "定义", "概念", "是指"]),
    ("symptom", ["症状", "表现", "特征", "感觉", "体征"]),
    ("treatment", ["治疗", "处理", "用药", "疗法", "手术"]),
    ("cause", ["原因", "为什么", "导致", "引起", "病因"]),
    ("diagnosis", ["诊断", "检查", "判断", "确诊", "需要做哪些检查"]),
    ("prevention", ["预防", "避免", "防止"]),
    ("complication", ["并发症", "后果", "影响", "危害"]),
    ("prognosis", ["预后", "恢复", "治愈", "能好吗"]),
    ("population", ["多发", "人群", "哪些人", "好发于", "儿童", "老年"]),
    ("department", ["科室", "挂号", "看什么科", "就诊"]),
    ("comparison", ["区别", "对比", "不同", "比较", "鉴别"]),
]

# Intents of the coarse classifier, first match wins.
INTENTS_COARSE = [
    ("symptom_query", ["症状", "表现", "特征", "感觉", "体征"]),
    ("treatment_query", ["治疗", "怎么治", "用药", "疗法", "手术"]),
    ("department_query", ["科室", "挂号", "看什么科", "就诊"]),
    ("prognosis_query", ["预后", "恢复", "治愈", "能好吗"]),
    ("population_query", ["多发", "人群", "哪些人", "好发于"]),
    ("cause_query", ["原因", "为什么", "病因", "导致"]),
    ("diagnosis_query", ["检查", "诊断", "确诊"]),
    ("complication_query", ["并发症", "后果", "影响"]),
]

# Intent patterns, first match wins.
INTENT_PATTERNS = [
    ("症状查询", "(什么症状|有.*症状|症状.*是|表现|临床表现)"),
    ("治疗查询", "(怎么治疗|如何治疗|治疗.*方法|吃什么药|用什么药|药物治疗)"),
    ("科室查询", "(看什么科|挂.*科|什么科室|哪个科|就诊科室)"),
    ("病因查询", "(什么疾病|哪些疾病|疾病.*症状|是.*病|可能是)"),
    ("药物查询", "(.*药.*作用|.*药.*治疗|.*药.*副作用|.*药.*功效)"),
]

# Words never kept as query keywords.
QUERY_STOPWORDS = [
    "的", "是", "在", "有", "和", "了", "吗", "呢", "啊", "吧",
    "什么", "如何", "怎么", "怎样", "为什么", "哪些", "哪个",
    "一个", "这个", "那个", "可以", "能够", "需要",
]

# Word parts that reveal an entity type, first match wins.
TYPE_KEYWORDS = [
    ("Disease", ["炎", "症", "病", "癌", "瘤", "疾", "综合征"]),
    ("Symptom", ["痛", "疼", "热", "肿", "吐", "泻", "晕", "咳", "红", "痒"]),
    ("Medicine", ["药", "素", "灵", "林", "西林", "激素", "片", "胶囊"]),
    ("Population", ["儿童", "成人", "老年", "孕妇", "群体"]),
    ("Department", ["科", "病房", "门诊", "内科", "外科"]),
    ("Hospital", ["医院", "中心", "研究所"]),
    ("PhysicalExamination", ["呼吸", "心率", "血压", "体温"]),
    ("LaboratoryExamination", ["血", "尿", "便", "常规", "生化"]),
    ("ImagingExamination", ["CT", "MRI", "超声", "X", "影像"]),
    ("AnatomicalSite", ["腹部", "颈部", "心脏", "胰腺", "肝", "肾"]),
    ("TCMTreatment", ["清热", "活血", "化瘀", "解毒", "中医"]),
    ("Surgery", ["手术", "介入", "切除"]),
    ("DrugTreatment", ["治疗", "用药", "输液"]),
    ("Prognosis", ["预后", "良好", "随访"]),
]
TYPE_KEYWORDS_FALLBACK = ("DrugTreatment", ["治疗", "手术", "疗法", "护理"])

# Entity names known to the short question matcher, and the letters its fallback looks for.
KNOWN_ENTITIES = ["轻度认知障碍", "阿尔茨海默", "记忆减退", "老年痴呆", "川崎病", "糖尿病", "高血压", "冠心病"]
ENTITY_HINTS = ["炎", "病", "症", "瘤"]

# Terms added to a query without a sure entity.
CARE_TERMS = ["认知障碍", "照护", "服药", "记忆", "日常安全", "复诊"]

# Relation types preferred per intent.
INTENT_RELATIONS = {
    "symptom": ["HAS_SYMPTOM"],
    "treatment": ["TREATED_BY", "TREATS_COMPLICATION"],
    "cause": ["HAS_ETIOLOGY"],
    "diagnosis": ["REQUIRES_EXAM", "HAS_ABNORMAL_EXAM_RESULT"],
    "prevention": ["PREVENTED_BY"],
    "complication": ["HAS_COMPLICATION"],
    "prognosis": ["HAS_PROGNOSIS"],
    "population": ["AFFECTS_POPULATION"],
    "department": ["BELONGS_TO_DEPARTMENT", "TREATED_AT_HOSPITAL"],
    "comparison": ["DIFFERENTIAL_DIAGNOSIS"],
}

# Answers that count as a refusal.
REFUSAL_PHRASES = [
    "详细信息请咨询专业医生", "请咨询专业医生", "无法直接获取", "图谱中未提供", "知识图谱中未", "没有足够的信息来回答",
    "无法从现有信息中得出结论",
]

# Scoring keywords per question category.
QA_KEYWORDS = {
    "symptom": ["腹痛", "疼痛", "恶心", "呕吐", "发热"],
    "treatment": ["禁食", "胃肠减压", "补液", "镇痛", "抑制胰酶"],
    "complication": ["呼吸窘迫", "肾功能不全", "器官功能衰竭", "ARDS"],
    "examination": ["超声", "B超", "增强CT", "CT", "MRI"],
    "etiology": ["胆结石", "胆源性", "饮酒", "酒精性", "高脂血症", "高钙血症"],
    "definition": ["急性炎症性疾病", "胰酶", "自我消化", "过早激活"],
    "department": ["消化内科", "普外科", "重症监护", "ICU"],
    "prognosis": ["预后", "病死率", "重症", "器官功能衰竭"],
    "population": ["中老年", "女性", "高危人群", "胆结石"],
    "cause": ["病因", "胆结石", "梗阻", "胆汁反流"],
    "severity": ["轻症", "重症", "器官功能衰竭", "坏死", "感染"],
    "prevention": ["预防", "复发", "戒酒", "低脂", "清淡饮食", "控制体重", "控制血脂"],
}

# Types kept by the core-type evaluation.
CORE_ENTITY_TYPES = ["DISEASE", "SYMPTOM", "COMPLICATION", "TREATMENT", "EXAMINATION", "LAB_RESULT", "PROGNOSIS"]
CORE_RELATION_TYPES = [
    "HAS_SYMPTOM", "HAS_COMPLICATION", "HAS_TREATMENT", "HAS_EXAMINATION", "HAS_LAB_ABNORMALITY", "HAS_PROGNOSIS",
]

# Behaviour metrics, (low, high) thresholds and weights.
BEHAVIOUR_THRESHOLDS = {
    "back_rate": (0.1, 0.3),
    "error_rate": (0.05, 0.15),
    "click_density": (0.3, 0.8),
    "duration_sec": (30.0, 180.0),
    "completion_rate": (0.9, 0.5),
}
BEHAVIOUR_WEIGHTS = {
    "back_rate": 0.25, "error_rate": 0.20, "click_density": 0.15, "duration_sec": 0.20, "completion_rate": 0.20,
}

# Questionnaire dimensions, labels, weights and norms.
TLX_DIMENSIONS = ["mental_demand", "physical_demand", "temporal_demand", "performance", "effort", "frustration"]
TLX_LABELS = {
    "mental_demand": "脑力需求", "physical_demand": "体力需求", "temporal_demand": "时间需求", "performance": "绩效感知",
    "effort": "努力程度", "frustration": "挫败感",
}
TLX_NORMS = {
    "mental_demand": 0.60, "physical_demand": 0.18, "temporal_demand": 0.32, "performance": 0.50, "effort": 0.70,
    "frustration": 0.30,
}
ELDERLY_NORM = 0.55

# Modality weights of the fused score.
MODALITY_WEIGHTS = {"behavior": 0.4, "questionnaire": 0.6, "eeg": 0.0}

# Level cut points (low, high) per score.
LEVEL_CUTS = {"behavior": (0.35, 0.65), "questionnaire": (0.4, 0.7), "fusion": (0.4, 0.7)}

# EEG electrode names of the source montage and of the headset, and frequency bands in Hz.
EEG_CHANNELS = {"T3": "TP9", "F7": "AF7", "F8": "AF8", "T4": "TP10"}
EEG_BANDS = {
    "delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0),
}
EEG_BANDS_HEADSET = {
    "delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 50.0),
}

# Node colours by type, the colour of other types, and display categories that differ from the type.
NODE_COLOURS = {
    "Disease": "#ff6b6b", "Symptom": "#4ecdc4", "Population": "#a29bfe", "Medicine": "#55efc4", "Prognosis": "#74b9ff",
    "PhysicalExamination": "#ffeaa7", "LaboratoryExamination": "#fdcb6e", "ImagingExamination": "#e17055",
    "PathologyExamination": "#d63031", "OtherExamination": "#e84393", "AbnormalExaminationResult": "#fd79a8",
    "TCMTreatment": "#00b894", "Surgery": "#0984e3", "DrugTreatment": "#6c5ce7", "WesternPhysicalTherapy": "#00cec9",
    "OtherTreatment": "#81ecec", "AnatomicalSite": "#dfe6e9", "AnatomicalSubstance": "#b2bec3",
    "MedicalEquipment": "#636e72", "Hospital": "#2d3436", "Department": "#fab1a0", "Gene": "#a8e6cf",
    "Microorganism": "#ff8b94", "PhysicalChemicalFactor": "#ffaaa5", "PsychologicalBehavior": "#ffd3b6",
    "Lifestyle": "#dcedd2", "ImmuneFactor": "#ffecd2", "DisuseFactor": "#e0bbe4", "ICD10Code": "#9575cd",
    "Synonym": "#b39ddb",
}
NODE_COLOUR_DEFAULT = "#9c27ff"
DISPLAY_CATEGORIES = {"department": "location", "complication": "disease", "riskfactor": "disease", "unknown": "disease"}
