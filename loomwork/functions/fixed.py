"""Fixed values that results must share with other graders and record formats."""

# Literal rewrites of a final answer, in order, and the strings then dropped.
FINAL_REWRITES = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"), ("\\le", "<"),
]
FINAL_DROPPED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots", "\n", "\r", "\f",
]
# Wrappers whose content replaces them, and marks whose last content is the answer.
FINAL_WRAPPERS = [r"\\text\{\((.*?)\)\}", r"\\text\{(.*?)\}", r"\\textbf\{(.*?)\}", r"\\overline\{(.*?)\}", r"\\boxed\{(.*)\}"]
FINAL_MARKS = [r"finalansweris(.*)", r"answer?is:?(.*)", r"oxed\{(.*?)\}", r"\$(.*?)\$"]
# Literal rewrites of an answer before and after its trailing unit is taken off, in order.
STRIP_FIRST = [("\\!", ""), ("\\ ", ""), ("\\\\", "\\"), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", "")]
STRIP_THEN = [
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\text", ""), ("x\\in", ""), ("\\%", ""), ("%", ""),
    (" .", " 0."), ("{.", "{0."), ("\\cdot", ""), ("infinity", "\\infty"),
]


# Subjects and categories by macro category; any other is commonsense.
MACRO_OF_SUBJECT = {
    "stem": [
        "abstract_algebra", "anatomy", "astronomy", "clinical_knowledge", "college_biology", "college_chemistry",
        "college_computer_science", "college_mathematics", "college_medicine", "college_physics", "computer_security",
        "conceptual_physics", "electrical_engineering", "elementary_mathematics", "high_school_biology",
        "high_school_chemistry", "high_school_computer_science", "high_school_mathematics", "high_school_physics",
        "high_school_statistics", "human_aging", "machine_learning", "medical_genetics", "nutrition",
        "professional_medicine", "virology",
    ],
    "humanities": [
        "formal_logic", "international_law", "jurisprudence", "logical_fallacies", "moral_disputes", "moral_scenarios",
        "philosophy", "professional_law", "world_religions",
    ],
    "social_sciences": [
        "business_ethics", "econometrics", "high_school_government_and_politics", "high_school_macroeconomics",
        "high_school_microeconomics", "high_school_psychology", "human_sexuality", "management", "marketing",
        "professional_accounting", "professional_psychology", "public_relations", "security_studies", "sociology",
    ],
    "history_geo": [
        "global_facts", "high_school_european_history", "high_school_geography", "high_school_us_history",
        "high_school_world_history", "prehistory", "us_foreign_policy",
    ],
    "commonsense": ["miscellaneous"],
}
MACRO_OF_CATEGORY = {
    "stem": ["math", "physics", "chemistry", "biology", "computer science", "engineering", "health"],
    "humanities": ["philosophy", "law"],
    "history_geo": ["history"],
    "social_sciences": ["business", "economics", "psychology"],
    "commonsense": ["other"],
}
# An older map; any other category is world_knowledge.
OLD_MACRO_OF_CATEGORY = {
    "science": ["math", "physics", "chemistry", "biology", "computer science", "engineering", "health"],
    "history": ["history", "geography"],
    "social_sciences": ["psychology", "sociology", "anthropology"],
    "humanities": ["philosophy", "law", "business", "economics"],
    "commonsense": ["other", "commonsense"],
}
# Subjects of the world-knowledge source, of three macro categories.
WORLD_SUBJECTS = [
    "high_school_world_history", "high_school_european_history", "high_school_us_history", "prehistory",
    "high_school_geography", "global_facts", "us_foreign_policy", "jurisprudence", "international_law", "world_religions",
    "formal_logic", "logical_fallacies", "moral_disputes", "philosophy", "professional_law", "business_ethics",
    "econometrics", "high_school_government_and_politics", "high_school_macroeconomics", "high_school_microeconomics",
    "high_school_psychology", "human_sexuality", "management", "marketing", "professional_accounting",
    "professional_psychology", "public_relations", "security_studies", "sociology",
]
# Default quotas of the macro categories and weights of expanded option counts.
MACRO_QUOTAS = {"stem": 0.25, "humanities": 0.20, "social_sciences": 0.20, "history_geo": 0.20, "commonsense": 0.15}
EXPAND_WEIGHTS = {k: 1.2 if 11 <= k <= 16 else 1.0 for k in range(6, 21)}
# Answers that are none, and gold answers that are garbage.
BAD_ANSWERS = ["proof", "none", "null", "nan", "n/a", "unknown"]
GARBAGE_GOLDS = ["unknown", "n/a", "none", "null"]
YES = ["yes", "true", "1"]
# Sources whose explanations are long, and the least length of either kind.
LONG_SOURCES = ["mmlu", "mmlu_world", "mmlu_pro_cot"]
LEAST_LONG, LEAST_SHORT = 1000, 200
# Sentences around answers in training records.
ANSWER_LINE = "The answer is \\boxed{%s}"
FINAL_LINE = "Therefore, the final answer is \\boxed{%s}."
PLAIN_LINE = "The correct answer is \\boxed{%s}"
