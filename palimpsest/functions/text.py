"""Text functions: tokens, sentences, rule extraction, similarity, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists and patterns of the rule extractor.
TECH_KEYWORDS = (
    "python", "typescript", "javascript", "go", "rust", "java", "react", "vue", "postgresql", "mysql", "redis", "sqlite",
    "docker", "kubernetes", "fastapi", "langchain", "openai", "claude", "llm", "ai", "ml", "api", "mcp",
)
PROPER_NOUN = r"\b([A-Z][a-zA-Z0-9]{2,})\b"
SENTENCE_END = "[。！？\n.!?]"
#: White space of any script; plain ``trim`` takes spaces only.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TAG_WORDS = {
    "preference": ("prefer", "偏好", "喜欢", "用", "use"),
    "project": ("project", "项目", "repo", "仓库"),
    "bug": ("fix", "bug", "修复", "issue"),
    "task": ("todo", "task", "任务", "待办"),
}
EPISODIC_WORDS = ("yesterday", "today", "ago", "昨天", "今天", "之前", "happened")
PROCEDURAL_WORDS = ("how to", "step", "first", "then", "步骤", "先", "然后")
IMPORTANT_WORDS = ("important", "critical", "must", "重要", "关键", "必须")


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.trim(text, F.lit(WHITE))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Some word is a substring of the lower-cased text."""
    low, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def keyword_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_`` in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Distinct lower-cased tokens between white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"\s+")), "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: strip(x)), lambda x: x != "")


def entities(text: Column, existing: Column | None = None, most: int = 5) -> Column:
    """Known technology words, then capitalised words; distinct in any case; sorted, then in text order."""
    tech = F.array_sort(F.array_intersect(F.split(F.lower(text), r"\s+"), F.array(*(F.lit(t) for t in TECH_KEYWORDS))))
    nouns = F.array_distinct(F.regexp_extract_all(text, F.lit(PROPER_NOUN), F.lit(1)))
    both = F.concat(tech, nouns)
    seen = F.aggregate(
        both,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    if existing is not None:
        seen = F.filter(seen, lambda x: ~F.array_contains(existing, F.lower(x)))
    return F.slice(seen, 1, most)


def tags(text: Column) -> Column:
    """T07."""
    return F.array_compact(F.array(*(F.when(has_any(text, w), F.lit(t)) for t, w in TAG_WORDS.items())))


def memory_type(text: Column) -> Column:
    """Episodic, then procedural, else semantic."""
    return F.when(has_any(text, EPISODIC_WORDS), "episodic").when(has_any(text, PROCEDURAL_WORDS), "procedural").otherwise("semantic")


def extracted_importance(text: Column, n_entities: Column) -> Column:
    """T09."""
    bonus = F.when(has_any(text, IMPORTANT_WORDS), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + F.least(n_entities * 0.05, F.lit(0.2)) + bonus)


def letter_counts(text: Column) -> Column:
    """Length of a text and its letters of three scripts, to be summed over texts."""
    count = lambda ranges: F.regexp_count(text, F.lit(ranges))
    return F.struct(F.length(text).alias("n"), count(r"[一-鿿㐀-䶿]").alias("zh"), count(r"[Ѐ-ӿ]").alias("ru"), count(r"[؀-ۿ]").alias("ar"))


def language_of(n: Column, zh: Column, ru: Column, ar: Column) -> Column:
    """T12 from letter counts: zh over 10 % CJK, then ru, ar, else en."""
    over = lambda letters: letters / F.greatest(n, F.lit(1)) > 0.1
    return F.when(over(zh), "zh").when(over(ru), "ru").when(over(ar), "ar").otherwise("en")


def language(text: Column) -> Column:
    """T12."""
    c = letter_counts(text)
    return language_of(c["n"], c["zh"], c["ru"], c["ar"])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of lower-cased white-space tokens; 1 if both are empty."""
    x, y = space_tokens(a), space_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def same_name(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or within two edits, in lower case."""
    x, y = F.lower(a), F.lower(b)
    return (x == y) | x.contains(y) | y.contains(x) | (F.levenshtein(x, y) <= 2)


def clean_html(html: Column) -> Column:
    """Text of a page without script, style, navigation, header and footer parts."""
    body = html
    for part in ("script", "style", "nav", "footer", "aside", "header"):
        body = F.regexp_replace(body, rf"(?is)<{part}\b.*?</{part}\s*>", " ")
    article = F.regexp_extract(body, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    main = F.regexp_extract(body, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1)
    body = F.when(F.length(article) > 200, article).when(F.length(main) > 200, main).otherwise(body)
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def sanitize(text: Column, most: int = 50_000) -> Column:
    """No control characters but line ends and tabs; cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", ""), 1, most)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4)


def snap_to_sentence(text: Column, most: int) -> Column:
    """The longest prefix of ``most`` characters that ends a sentence, else the plain prefix."""
    head = F.substring(text, 1, most)
    snapped = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(snapped != "", snapped).otherwise(head)


def parameter_key(*parameters: Column) -> Column:
    """A digest of all parameters of a request."""
    return F.sha2(F.to_json(F.struct(*parameters)), 256)


def word_in(query: Column, text: Column) -> Column:
    """Some query word of more than two letters is contained in the text."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)
    return F.exists(words, lambda w: F.contains(F.lower(text), w))
