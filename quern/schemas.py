"""Vocabularies and constants of the knowledge-graph model. All are fixed values."""

NODE_KINDS = ("entity", "concept", "property", "process", "event", "method", "rule", "representation", "resource")
DOMAINS = (
    "mathematics", "physics", "chemistry", "biology", "earth-science", "astronomy", "computer-science", "engineering", "language-arts",
    "linguistics", "literature", "history", "geography", "civics", "economics", "law", "education", "arts", "music", "health", "sports",
    "philosophy", "general",
)
KNOWLEDGE_FORMS = ("propositional", "practical")
LEARNING_MODES = ("factual", "conceptual", "procedural", "metacognitive")
SCOPES = ("universal", "domain-specific", "culture-specific")
EDGE_TYPES = (
    "is_a", "instance_of", "part_of", "contains", "has_property", "uses", "produces", "depends_on", "prerequisite_for", "causes", "affects",
    "represents", "about", "same_as", "related_to",
)
HIERARCHICAL_EDGE_TYPES = ("is_a", "instance_of", "part_of", "contains", "depends_on", "prerequisite_for")
CYCLE_FREE_CHECK_SKIPS = ("related_to", "same_as")
SCHOOL_STAGES = ("primary", "junior-secondary", "senior-secondary", "higher")
CURRICULUM_ROLES = ("core", "support", "assessment", "practice", "literacy")
CARD_SECTIONS = ("definition", "essence", "key_points", "example", "application", "misconception")
BODY_ORIGINS = ("manual", "card_expansion", "imported_unit", "model_generation")

MATCH_THRESHOLD, EMBEDDING_THRESHOLD, REVIEW_THRESHOLD = 0.88, 0.92, 0.74
LEXICAL_WEIGHT, SEMANTIC_WEIGHT, EMBEDDING_WEIGHT = 0.45, 0.35, 0.20
SUBKIND_PENALTY, EXACT_FLOOR, EMBEDDING_FLOOR, EMBEDDING_LEXICAL, CONTAINMENT = 0.85, 0.94, 0.90, 0.65, 0.96
RRF_K = 60
SCORE_EXACT, SCORE_PREFIX, SCORE_DEFINITION = 100.0, 85.0, 70.0
VECTOR_BASE, VECTOR_SCALE, VECTOR_LEAST = 40.0, 50.0, 0.5
DUPLICATE_BONUS = 0.1
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX = 150, 250, 300

#: Patterns of titles by content role, tried in this order.
ASSESSMENT_TITLE = "复习题|习题|练习|作业|测试|检测|自测|巩固题|思考题|训练题|单元测评|综合测评"
SUMMARY_TITLE = "小结|归纳总结|本章总结|单元总结|知识总结|知识回顾|要点回顾|复习要点|^复习$"
EXCLUDED_TITLE = "参考文献|索引|版权页|编写说明|后记"
#: Patterns of node names that need a review before admission.
STRUCTURAL_NAMES = (
    r"^第[\d一二三四五六七八九十百千万]+[章节课单元]",
    "^(本节小结|章末小结|单元小结|复习|练习|习题|单元检测|实验活动|探究活动|活动与探究|观察与思考|思考与讨论|资料卡片|阅读材料|科学史话|你知道吗)",
    r"(?i)^(chapter|unit|section|lesson|review|exercise)\b",
)
ASSESSMENT_NAMES = ("^(考点|题型|专题|中考|高考|选择题|填空题|判断题|实验题|计算题|综合题|易错题)", r"(?i)^(exam point|question type|exercise type)\b")
GENERIC_SUBKINDS = ("definition", "classification", "property", "principle", "theory")
#: Subkind names and their codes.
SUBKIND_CODES = {
    "物理定律": "physical_law", "物理规律": "physical_law", "核心规律总结": "physical_law", "物理公式": "physical_formula", "电路计算公式": "circuit_formula",
    "电路连接方式": "circuit_configuration", "物理量": "physical_quantity", "基本电学物理量": "physical_quantity", "矢量物理量": "vector_quantity",
    "标量": "scalar_quantity", "标量/状态量": "scalar_state_quantity", "物理参数": "physical_parameter", "电势差": "electric_potential_difference",
    "阻碍作用": "resistance_effect", "测量仪器": "measurement_instrument", "检测工具": "measurement_instrument", "实验器材": "experimental_device",
    "实验操作步骤": "experimental_method", "实验观测方法": "experimental_method", "演示实验": "demonstration_experiment", "经典物理实验": "physics_experiment",
    "电学测量方法": "electrical_measurement_method", "分析计算方法": "analysis_method", "物理现象": "physical_phenomenon", "自然现象": "natural_phenomenon",
    "电学现象": "electrical_phenomenon", "电路异常状态": "circuit_fault_state", "电路特殊状态": "circuit_state", "电路拓扑结构": "circuit_configuration",
    "电路模型": "circuit_model", "理想化模型": "idealized_model", "物理模型": "physical_model", "物理图像模型": "physical_model", "实验数据图像": "experimental_graph",
    "图形标识规范": "graphical_notation", "几何模型": "geometric_model", "物理过程": "physical_process", "微观物理过程": "microscopic_physical_process",
    "安全机制": "safety_mechanism", "安全措施": "safety_measure", "方向判断法则": "direction_rule", "功能关系": "functional_relation", "场性质": "field_property_rule",
}
