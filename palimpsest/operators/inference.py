"""What a user's memories tell about the user: intent, preferences, knowledge, style.

memories: user_id, id, created_at, content.  A word counts once for each memory whose lower-cased
text contains it; a null text contains nothing and has no length.  Of equal counts the one met
first wins: by (created_at, id) of the first memory, then by its place in the table.  Hits are
added up before they are shuffled, so a user with a third of all rows is a few rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.shared import stored

# Words of each category, in the order that breaks ties.
INTENTS = {
    "informational": ["what", "how", "why", "explain", "tell me", "information", "了解", "什么是", "怎么", "为什么", "解释"],
    "transactional": ["create", "make", "build", "generate", "write", "do", "创建", "生成", "写", "构建", "制作"],
    "troubleshooting": ["fix", "error", "bug", "issue", "problem", "not working", "修复", "错误", "bug", "问题", "故障"],
    "learning": ["learn", "tutorial", "guide", "course", "study", "学习", "教程", "指南", "课程"],
    "creative": ["design", "idea", "brainstorm", "creative", "story", "设计", "创意", "头脑风暴", "故事"],
    "social": ["chat", "talk", "discuss", "opinion", "think", "聊天", "讨论", "看法", "观点"],
}

# Words of each value of each type of preference.
PREFERENCES = {
    "technology": {"python": ["python", "py"], "javascript": ["javascript", "js", "node"], "typescript": ["typescript", "ts"], "rust": ["rust", "rs"], "go": ["go", "golang"], "java": ["java"], "cpp": ["c++", "cpp"]},
    "format": {"json": ["json"], "markdown": ["markdown", "md"], "code": ["code", "snippet"], "table": ["table", "表格"]},
    "tone": {"formal": ["formal", "professional", "正式"], "casual": ["casual", "friendly", "随意"], "technical": ["technical", "技术"], "humorous": ["humor", "funny", "幽默"]},
    "depth": {"brief": ["brief", "short", "简洁", "简单"], "detailed": ["detailed", "thorough", "详细", "深入"]},
    "language": {"chinese": ["chinese", "中文", "汉语"], "english": ["english", "英文", "英语"], "japanese": ["japanese", "日文", "日语"]},
}

# Words of each field of knowledge.
KNOWLEDGE = {
    "machine_learning": ["ml", "machine learning", "深度学习", "神经网络", "模型训练"],
    "web_development": ["web", "frontend", "backend", "html", "css", "react", "vue"],
    "data_science": ["data", "pandas", "numpy", "数据分析", "可视化"],
    "devops": ["docker", "kubernetes", "k8s", "ci/cd", "部署", "运维"],
    "mobile": ["android", "ios", "flutter", "react native", "移动端"],
    "security": ["security", "安全", "加密", "漏洞", "渗透"],
}

# Words that tell how much a user knows.
LEVELS = {
    "beginner": ["beginner", "new to", "start", "入门", "新手", "基础"],
    "advanced": ["advanced", "optimize", "architecture", "deep dive", "高级", "优化", "架构", "深入"],
    "expert": ["expert", "contribute", "design pattern", "internals", "专家", "源码", "原理", "内核"],
}

# Words of each style, and those that follow up on what was said.
STYLES = {
    "concise": ["brief", "short", "quick", "简单", "简洁"],
    "detailed": ["detailed", "thorough", "comprehensive", "详细", "全面"],
    "technical": ["technical", "implementation", "algorithm", "技术", "实现"],
    "conversational": ["chat", "discuss", "talk", "聊聊", "讨论"],
    "formal": ["formal", "professional", "official", "正式", "官方"],
    "casual": ["casual", "relaxed", "随意", "轻松"],
    "visual": ["diagram", "chart", "image", "visual", "图", "图表"],
    "structured": ["step", "structure", "outline", "步骤", "结构"],
}
FOLLOWING = ["also", "another", "additionally", "还有", "另外", "再"]

# Fields to which preferences of a field carry over.
NEAR_FIELDS = {
    "machine_learning": ["data_science", "web_development", "mobile"],
    "web_development": ["mobile", "devops", "security"],
    "devops": ["web_development", "security", "data_science"],
    "data_science": ["machine_learning", "web_development"],
    "security": ["web_development", "devops", "mobile"],
    "mobile": ["web_development", "security"],
}


TABLES = {"intent": INTENTS, **PREFERENCES, "knowledge": KNOWLEDGE, "level": LEVELS, "style": STYLES}


def _words_in(low: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), w) for w in words)))


def category_hits(memories: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(user_id, at, kind, found): for each memory and kind of TABLES, the categories of which it has a word.

    at: (created_at, id); found: structs of category, place in the table, words.  Written once, as
    texts are read in one pass for all ``kinds`` (default: all) and every inference takes it as ``hits``.
    """
    low = memories.select("user_id", F.struct("created_at", "id").alias("at"), F.lower("content").alias("low"))
    wanted = list(kinds or TABLES)
    sets = low.select("user_id", "at", *(F.array(*(_words_in(F.col("low"), w) for w in TABLES[k].values())).alias(f"_{k}") for k in wanted))

    def kind_of(kind: str) -> Column:
        names = F.array(*map(F.lit, TABLES[kind]))
        rows = F.transform(F.col(f"_{kind}"), lambda w, i: F.struct(F.get(names, i).alias("category"), i.alias("place"), w.alias("words")))
        return F.struct(F.lit(kind).alias("kind"), F.filter(rows, lambda r: F.size(r["words"]) > 0).alias("found"))

    rows = sets.select("user_id", "at", F.explode(F.array(*map(kind_of, wanted))).alias("k")).where(F.size("k.found") > 0)
    return stored(rows.select("user_id", "at", "k.kind", "k.found"), "hits")


def _of(memories: DataFrame, hits: DataFrame | None, kinds: list[str]) -> DataFrame:
    return (category_hits(memories, kinds) if hits is None else hits).where(F.col("kind").isin(kinds))


def _counted(hits: DataFrame) -> DataFrame:
    """(user_id, kind, category, hits, order, words): order sorts the most frequent first."""
    rows = hits.select("user_id", "kind", "at", F.explode("found").alias("f"))
    sums = rows.groupBy("user_id", "kind", "f.category", "f.place").agg(F.sum(F.size("f.words")).alias("hits"), F.min("at").alias("first"), F.flatten(F.collect_set("f.words")).alias("words"))
    return sums.select("user_id", "kind", "category", "hits", F.struct(-F.col("hits"), "first", "place").alias("order"), "words")


def _evidence(rows: DataFrame, by: list[str]) -> DataFrame:
    """The five smallest ids of each key, once each; ranks are cut in every task before the shuffle."""
    w = Window.partitionBy(*by).orderBy("id")
    few = rows.select(*by, "id").withColumn("_n", F.dense_rank().over(w)).where("_n <= 5")
    return few.groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("evidence"))


def _users(memories: DataFrame) -> DataFrame:
    return memories.select("user_id").distinct()


def intents(memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """user_id, category, keywords (the first ten in order), confidence.

    The category of most hits, sure by hits / max(half of all, 1), at most 0.95; without a hit
    informational, 0.3.  A null user_id is a user like another.
    """
    c = _counted(_of(memories, hits, ["intent"]))
    best = c.groupBy("user_id").agg(
        F.min(F.struct("order", "category", "hits")).alias("b"), F.sum("hits").alias("total"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words")
    )
    sure = F.least(F.lit(0.95), F.col("b.hits") / F.greatest(F.col("total") * 0.5, F.lit(1.0)))
    found = best.select(F.col("user_id").alias("u"), F.col("b.category").alias("c"), F.slice("words", 1, 10).alias("w"), F.round(sure, 3).alias("s"))
    rows = _users(memories).join(found, F.col("user_id").eqNullSafe(F.col("u")), "left")
    return rows.select(
        "user_id", F.coalesce("c", F.lit("informational")).alias("category"), F.coalesce("w", F.array().cast("array<string>")).alias("keywords"), F.coalesce("s", F.lit(0.3)).alias("confidence")
    )


def preferences(memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """user_id, type, value, strength, confidence, evidence, for each type with a hit.

    strength min(.95, hits / max(.6 total, 1)), confidence min(.9, .4 + .5 strength); evidence
    are the five smallest ids of memories with a word of the type.
    """
    hits = _of(memories, hits, list(PREFERENCES))
    best = _counted(hits).groupBy("user_id", "kind").agg(F.min(F.struct("order", "category", "hits")).alias("b"), F.sum("hits").alias("total"))
    strength = F.least(F.lit(0.95), F.col("b.hits") / F.greatest(F.col("total") * 0.6, F.lit(1.0)))
    sure = F.least(F.lit(0.9), F.lit(0.4) + strength * 0.5)
    rows = best.select("user_id", F.col("kind").alias("type"), F.col("b.category").alias("value"), F.round(strength, 3).alias("strength"), F.round(sure, 3).alias("confidence"))
    seen = _evidence(hits.select("user_id", F.col("kind").alias("type"), "at.id"), ["user_id", "type"]).withColumnsRenamed({"user_id": "_u", "type": "_t"})
    return rows.join(seen, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("type") == F.col("_t"))).drop("_u", "_t")


def levels(memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """user_id, level, for all users: expert if its words are there and as many as advanced ones, then advanced against beginner, then beginner, else intermediate."""
    c = _counted(_of(memories, hits, ["level"])).groupBy("user_id").pivot("category", list(LEVELS)).agg(F.sum("hits"))
    found = c.select(F.col("user_id").alias("u"), *(F.coalesce(k, F.lit(0)).alias(k) for k in LEVELS))
    level = (
        F.when((F.col("expert") > 0) & (F.col("expert") >= F.col("advanced")), "expert")
        .when((F.col("advanced") > 0) & (F.col("advanced") >= F.col("beginner")), "advanced")
        .when(F.col("beginner") > 0, "beginner")
        .otherwise("intermediate")
    )
    return _users(memories).join(found, F.col("user_id").eqNullSafe(F.col("u")), "left").select("user_id", level.alias("level"))


def knowledge(memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """user_id, domain, level, confidence min(.85, .4 + .1 hits), evidence, rank: the five fields of most hits."""
    both = _of(memories, hits, ["knowledge", "level"])
    hits = both.where("kind = 'knowledge'")
    w = Window.partitionBy("user_id").orderBy("order")
    top = _counted(hits).withColumn("rank", F.row_number().over(w)).where("rank <= 5")  # six rows a user at most
    rows = top.select("user_id", F.col("category").alias("domain"), F.round(F.least(F.lit(0.85), F.lit(0.4) + F.col("hits") * 0.1), 3).alias("confidence"), "rank")
    each = hits.select("user_id", "at.id", F.explode("found.category").alias("domain"))
    seen = _evidence(each, ["user_id", "domain"]).withColumnsRenamed({"user_id": "_u", "domain": "_d"})
    rows = rows.join(seen, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("domain") == F.col("_d"))).drop("_u", "_d")
    level = levels(memories, both).withColumnRenamed("user_id", "_u")
    return rows.join(level, F.col("user_id").eqNullSafe(F.col("_u"))).drop("_u")


def interaction(memories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """user_id, communication, initiative, detail_level, follow_up, confidence.

    detail_level .8, .6 or .4 by mean length over 200, over 100, else; initiative grows with
    question marks for each memory; follow_up: words of FOLLOWING in a tenth of the memories
    or more; the style as in intents, conversational at 0.3 without a hit.
    """
    text = F.coalesce("content", F.lit(""))
    facts = memories.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.length(text)).alias("length"), F.sum(F.regexp_count(text, F.lit("[?？]"))).alias("asked"), F.sum(F.size(_words_in(F.lower(text), FOLLOWING))).alias("follows")
    )
    c = _counted(_of(memories, hits, ["style"]))
    best = c.groupBy(F.col("user_id").alias("u")).agg(F.min(F.struct("order", "category", "hits")).alias("b"), F.sum("hits").alias("total"))
    rows = facts.join(best, F.col("user_id").eqNullSafe(F.col("u")), "left")
    mean = F.col("length") / F.col("n")
    sure = F.least(F.lit(0.9), F.col("b.hits") / F.greatest(F.col("total") * 0.5, F.lit(1.0)))
    return rows.select(
        "user_id",
        F.coalesce("b.category", F.lit("conversational")).alias("communication"),
        F.round(F.least(F.lit(0.9), F.lit(0.3) + F.col("asked") / F.col("n") * 0.3), 3).alias("initiative"),
        F.when(mean > 200, 0.8).when(mean > 100, 0.6).otherwise(0.4).alias("detail_level"),
        (F.col("follows") >= F.col("n") * 0.1).alias("follow_up"),
        F.when(F.col("b").isNull(), 0.3).otherwise(F.round(sure, 3)).alias("confidence"),
    )


def transferred(prefs: DataFrame, domains: DataFrame) -> DataFrame:
    """(user_id, name, value, strength, confidence) of preferences carried to near fields.

    prefs: as of preferences; domains: user_id, source_domain, and optionally targets (an array; null
    or empty: NEAR_FIELDS).  confidence min(.7, .6 c + .1), without the .1 for a target not near.
    A field without near ones and without targets gives no row.
    """
    near = F.create_map(*(x for k, v in NEAR_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(near[F.col("source_domain")], F.array().cast("array<string>"))
    goals = F.when(F.coalesce(F.size("targets"), F.lit(0)) > 0, F.col("targets")).otherwise(own) if "targets" in domains.columns else own
    rows = domains.select("user_id", own.alias("own"), F.explode(F.array_distinct(goals)).alias("target")).distinct()
    sure = F.least(F.lit(0.7), F.col("confidence") * 0.6 + F.when(F.array_contains("own", F.col("target")), 0.1).otherwise(0.0))
    return prefs.join(rows, "user_id").select("user_id", F.concat_ws("_", F.lit("transferred"), "target", "type").alias("name"), "value", "strength", F.round(sure, 3).alias("confidence"))
