"""Features of Chinese prompts: the columns of `features.with_features` by the forms of Chinese.

Words are runs of white-space text without CJK characters, and single characters of parts that hold any: no dictionary is needed. Blank and
null texts have zero counts and no flags. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import features
from parlance.functions import text as X

# Patterns of the features.
PATTERNS = {
    "role": r"(?m)^(?:你是一?个?|作为|扮演|角色[:：]|假设你是|假装你是|你现在是)",
    "constraints": r"不要|不能|不可以|必须|请勿|禁止|务必|确保|限制|仅|只能|除非|避免|不得|严禁|切勿|一定要|保证|不许",
    "examples": r"(?s)例如|比如|举例|示例|像是|譬如|输入[:：].*输出[:：]|如[:：]|比方说",
    "output_format": r"(?:输出|返回|格式|响应).*(?:JSON|json|表格|列表|markdown|Markdown|csv|CSV|yaml|YAML|xml|XML)|以.*格式(?:输出|返回|响应)|(?:JSON|json|表格|列表|markdown|csv).*(?:格式|字段|列)",
    "steps": r"分步骤|逐步|一步一步|一步步|第[一二三四五六七八九十]步|先.*然后.*最后|思维链|chain of thought|step[- ]by[- ]step",
    "sections": r"(?m)^#{1,4}\s+\S|^[一二三四五六七八九十]+[、.]\s*\S",
    "code": X.CODE_BLOCK,
    "files": r"(?:[\w./~-]+\.(?:py|ts|js|go|rs|java|rb|cpp|c|h|jsx|tsx|vue|svelte|css|html|yaml|yml|toml|json|sql|sh|md))|(?:(?:第|line\s+)\d+(?:行)?)|(?::\d+(?::\d+)?)",
    "errors": r"(?i)error|exception|traceback|failed|fail|错误|异常|报错|失败|崩溃",
    "numbers": r"\b\d+\b",
    "identifiers": r"\b[A-Z][a-z]+[A-Z]\w*\b|\b\w+_\w+\b",
}
# Words that say little, hedges, verbs that begin an instruction, and characters that do not count as repeated.
VAGUE_WORDS = ["东西", "那个", "这个", "什么", "一些", "某些", "之类", "等等", "大概", "好像", "可能", "随便", "差不多"]
HEDGES = ["可能", "也许", "大概", "或许", "好像", "似乎", "感觉", "我觉得", "我想", "我猜", "应该", "差不多"]
ACTION_VERBS = ["修复", "修改", "添加", "创建", "实现", "调试", "解释", "编写", "更新", "删除", "重构", "构建", "测试", "审查", "部署", "迁移", "优化", "移除", "重命名", "安装", "配置", "分析", "设计", "检查", "生成", "查找", "帮我", "请"]
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "被", "从", "把", "那",
    "里", "让", "用", "中", "为", "地", "得", "对", "以", "与",
]
_HAN = r"[\x{4e00}-\x{9fff}]"


def words(s: Column) -> Column:
    """White-space parts; those with CJK characters by single characters."""
    return F.flatten(F.transform(X.split_words(s), lambda w: F.when(w.rlike(_HAN), F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns that `features.with_features` adds; input and output and edge cases have no Chinese form and are not looked for."""
    s = F.coalesce(X.strip_ascii(F.col(text)), F.lit(""))
    df = df.withColumn("_s", s).withColumn("_words", words(F.col("_s"))).withColumn("_line", F.trim(F.substring_index("_s", "\n", 1)))
    n = lambda k: X.count(F.col("_s"), PATTERNS[k])
    df = df.withColumns({f"n_{k}": n(k) for k in ("constraints", "sections", "code", "files", "numbers", "identifiers")})
    df = df.withColumns({f"has_{k}": F.col("_s").rlike(PATTERNS[k]) for k in ("role", "examples", "output_format", "steps", "errors")})
    headed = X.count(F.col("_s"), r"(?:示例|例子|例)\s*\d*\s*[:：]") + X.count(F.col("_s"), r"(?s)输入[:：].*?输出[:：]")
    df = df.withColumns({
        "has_io_spec": F.lit(False),
        "has_edge_cases": F.lit(False),
        "n_words": F.size("_words").cast("bigint"),
        "n_lines": F.when(F.length("_s") == 0, F.lit(0)).otherwise(F.size(F.split("_s", "\n"))).cast("bigint"),
        "n_sentences": F.greatest(F.lit(1), F.size(F.filter(F.split("_s", "[。！？；!?]+"), lambda x: F.length(F.trim(x)) > 0))).cast("bigint"),
        "n_examples": F.when(headed > 0, headed).otherwise(F.col("_s").rlike("例如|比如|举例|示例|譬如").cast("bigint")),
        "has_constraints": F.col("n_constraints") > 0,
        "has_files": F.col("n_files") > 0,
        "has_code": F.col("n_code") > 0,
    })
    # Words of two characters or more come first, then single characters.
    plain = F.filter("_words", lambda w: ~w.isin(STOP_WORDS))
    content = F.concat(F.filter(plain, lambda w: F.length(w) >= 2), F.filter(plain, lambda w: (F.length(w) == 1) & w.rlike(_HAN)))
    df = df.withColumn("_content", F.when(F.col("n_words") >= 4, content).otherwise(F.array().cast("array<string>")))
    surplus, first = F.size("_content") - F.size(F.array_distinct("_content")), F.get("_content", F.lit(0))
    df = df.withColumns({
        "repetition": F.when(F.size("_content") > 0, surplus / F.size("_content")).otherwise(0.0),
        "repeats_first": F.coalesce(F.size(F.filter("_content", lambda w: w == first)) > 1, F.lit(False)),
    })
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    vague = F.size(F.filter("_words", lambda w: w.isin(VAGUE_WORDS)))
    hedges = sum((F.when(F.col("_s").contains(h), 1).otherwise(0) for h in HEDGES), F.lit(0))
    ambiguity = F.least(vague / F.greatest("n_words", F.lit(1)) * 3, F.lit(0.4)) + F.least(hedges * 0.1, F.lit(0.3)) + F.when(F.col("n_words") < 3, 0.3).when(F.col("n_words") < 6, 0.1).otherwise(0.0)
    starts = F.lit(False)
    for v in ACTION_VERBS:
        starts |= F.col("_line").startswith(v)
    opening = (
        flag(starts, 0.4)
        + flag(F.col("_line").rlike(PATTERNS["files"]), 0.3)
        + flag(F.col("_line").rlike(PATTERNS["errors"]), 0.2)
        + flag((X.count(F.col("_line"), _HAN) >= 8) | (F.length("_line") >= 15), 0.1)
    )
    specificity = flag(F.col("has_code"), 0.3) + flag(F.col("has_files"), 0.25) + flag(F.col("has_errors"), 0.25) + F.when(F.col("n_numbers") >= 2, 0.1).when(F.col("n_numbers") == 1, 0.05).otherwise(0.0) + flag(F.col("n_identifiers") > 0, 0.1)
    complexity = (
        F.when(F.col("n_words") > 100, 0.3).when(F.col("n_words") > 50, 0.2).when(F.col("n_words") > 25, 0.1).otherwise(0.0)
        + F.when(F.col("n_sentences") > 5, 0.2).when(F.col("n_sentences") > 2, 0.1).otherwise(0.0)
        + F.least(F.col("n_code") * 0.1, F.lit(0.2)) + F.least(F.col("n_constraints") * 0.05, F.lit(0.15)) + F.least(F.col("n_sections") * 0.05, F.lit(0.15))
    )
    some = F.col("n_words") > 0
    df = df.withColumns({
        "ambiguity": F.when(some, F.least(ambiguity, F.lit(1.0))).otherwise(1.0),
        "opening": F.least(opening, F.lit(1.0)),
        "specificity": F.when(some, F.least(specificity, F.lit(1.0))).otherwise(0.0),
        "complexity": F.least(complexity, F.lit(1.0)),
    })
    return df.drop("_s", "_words", "_line", "_content")


def routed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the features of each text by its language: Chinese forms for Chinese, English ones for all others, and the column locale."""
    counts = X.script_counts(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("locale", X.language(counts))
    keep = df.columns
    zh = with_features(df.filter("locale = 'zh'"), text)
    en = features.with_features(df.filter("locale <> 'zh'"), text)
    return en.unionByName(zh.select(*en.columns)).select(*keep, *[c for c in en.columns if c not in keep])
