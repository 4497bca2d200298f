"""Scalar text functions as native columns: cleaning, classification, normalisation, hashing, token counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[ \\t\\n\\r\\f\\x0b]+"
HANGUL = "[\\uac00-\\ud7af]"

# Patterns of relational and factual questions.
RELATIONAL = [
    "과.{0,20}관계", "와.{0,20}관계", "에\\s*연결된", "와\\s*관련된", "과\\s*관련된", "간의?\\s*관계", "사이의?\\s*관계", "어떤\\s*관계", "연관[된성]", "관련\\s*있는", "연결[된고]", "의존[하성]", "영향을?\\s*[주미받]", "상호작용", "에\\s*속[하한]",
]
FACTUAL = [
    "[은는이가]\\s*무엇", "[은는이가]\\s*뭐", "[은는이가]\\s*뭔", "의\\s*정의", "[이]?란\\s*[무뭐]", "[이]?란$", "[이]?란\\?", "무슨\\s*뜻", "의미[가는]?\\s*[무뭐]", "어떤\\s*것[인이]", "개념[이을]", "원리[가를는]", "어떻게\\s*동작", "어떻게\\s*작동", "어떻게\\s*[되동작]", "방법[이을은는]?\\s*[무뭐]", "차이[가점는]?\\s*[무뭐]",
]
STRATEGY = {"factual": "vector", "relational": "graph", "keyword": "keyword", "complex": "hybrid"}
# Words that make a plan lean on keywords or on meaning.
KEYWORD_SIGNS = ["에러", "error", "exception", "코드", "code", "api", "함수", "function", "class", "파일", "버전", "version", "설정", "config"]
MEANING_SIGNS = ["설명", "explain", "이란", "무엇", "what", "어떻게", "how", "왜", "why", "비교", "차이", "장단점", "방법", "개념"]
# Entity types, their synonyms, labels and merge keys.
ENTITY_TYPES = {
    "person": "Person", "people": "Person", "organization": "Organization", "org": "Organization", "company": "Organization", "technology": "Technology", "tech": "Technology", "tool": "Technology", "framework": "Technology", "language": "Technology", "project": "Project", "concept": "Concept", "method": "Concept", "methodology": "Concept", "date": "Date", "time": "Date", "period": "Date", "location": "Location", "place": "Location",
}
TYPE_LABELS = {"Person": "Person", "Organization": "Person", "Technology": "Technology", "Project": "Topic", "Concept": "Topic", "Date": "Keyword", "Location": "Keyword"}
LABEL_KEYS = {"Person": "person_id", "Technology": "name", "Topic": "name", "Keyword": "value"}
# Document types by words in the path, then in the content.
PATH_TYPES = {"design": "technical", "planning": "technical", "implementation": "technical", "testing": "technical", "development": "guide", "deployment": "guide", "maintenance": "guide", "guide": "guide", "manual": "guide", "presentation": "presentation", "policy": "policy", "standard": "standard", "report": "report"}
CONTENT_TYPES = {"technical": ["설계", "아키텍처", "스키마", "api"], "guide": ["가이드", "매뉴얼", "사용법", "설치"], "report": ["보고", "결과", "분석"]}
STATUSES = ["queued", "processing", "parsing", "chunking", "embedding", "storing", "extracting", "completed", "failed"]
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx", "xlsx": "xlsx", "xls": "xlsx", "hwp": "hwp", "md": "markdown", "txt": "text", "html": "html", "htm": "html", "ipynb": "ipynb"}
# Words of a title that name nothing.
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "of", "in", "on", "to", "with", "by", "from", "at", "is", "are", "was", "were", "be", "how", "what", "why", "when", "where", "who", "which", "explained", "introduction", "overview", "guide", "tutorial"]
JUNK_PARTS = [".py", ".ts", ".js", ".json", "//", "()", "{}", "*"]
JUNK_DOCS = [".md", ".yml", ".yaml"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def words(c: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def estimated_tokens(c: Column) -> Column:
    """F8: a third of the Hangul syllables plus 1.3 per other word, 1 at least; 0 for empty text."""
    other = F.size(words(F.regexp_replace(c, HANGUL, " ")))
    n = F.greatest(F.lit(1), F.floor(F.regexp_count(c, F.lit(HANGUL)) / 3.0 + other * 1.3))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(n).cast("long")


def query_type(c: Column) -> Column:
    """G1."""
    s = F.regexp_replace(c, "^\\s+|\\s+$", "")
    n = F.size(words(s))
    factual = any_of([s.rlike(p) for p in FACTUAL]) | ((n <= 5) & s.rlike("[을를]\\s*(설명|알려)"))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "complex")
        .when(any_of([s.rlike(p) for p in RELATIONAL]), "relational")
        .when((n <= 8) & factual, "factual")
        .when((n <= 2) & ~s.rlike("[?？]"), "keyword")
        .otherwise("complex")
    )


def search_strategy(kind: Column) -> Column:
    return F.coalesce(lookup(kind, STRATEGY), F.lit("hybrid"))


def planned_strategy(c: Column) -> Column:
    """Which signs prevail; both or neither make a hybrid."""
    low = F.lower(c)
    k = sum([F.contains(low, F.lit(x)).cast("int") for x in KEYWORD_SIGNS], F.lit(0))
    m = sum([F.contains(low, F.lit(x)).cast("int") for x in MEANING_SIGNS], F.lit(0))
    return F.when((k > 0) & (m > 0), "hybrid").when(k > m, "keyword").when(m > k, "semantic").otherwise("hybrid")


def query_words(c: Column) -> Column:
    """Words of two characters or more without end punctuation, also without Korean particles, each once."""
    raw = F.filter(words(c), lambda w: F.length(w) >= 2)
    clean = lambda w: F.regexp_replace(w, "[?!.。,;:]+$", "")
    bare = lambda w: F.regexp_replace(clean(w), "[은는이가을를의와과에서로도만으로부터까지에게]+$", "")
    found = F.array_distinct(F.filter(F.flatten(F.transform(raw, lambda w: F.array(bare(w), clean(w)))), lambda w: F.length(w) >= 2))
    return F.when(F.size(found) == 0, F.array(c)).otherwise(found)


def entity_type(c: Column) -> Column:
    """G4."""
    known = c.isin(sorted(set(ENTITY_TYPES.values())))
    return F.coalesce(lookup(F.lower(F.trim(c)), ENTITY_TYPES), F.when(known, c), F.lit("Concept"))


def graph_label(kind: Column) -> Column:
    """G5."""
    return F.coalesce(lookup(kind, TYPE_LABELS), F.lit("Topic"))


def merge_key(label: Column) -> Column:
    return F.coalesce(lookup(label, LABEL_KEYS), F.lit("name"))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def document_type(path: Column, content: Column, declared: Column | None = None) -> Column:
    """Declared, else the first path word that fits, else content words in the first 2000 characters."""
    low, head = F.lower(path), F.lower(F.substring(content, 1, 2000))
    out = F.when(F.coalesce(declared, F.lit("unknown")) != "unknown", declared) if declared is not None else F.when(F.lit(False), "")
    for word, kind in PATH_TYPES.items():
        out = out.when(F.contains(low, F.lit(word)), kind)
    for kind, signs in CONTENT_TYPES.items():
        out = out.when(any_of([F.contains(head, F.lit(x)) for x in signs]), kind)
    return out.otherwise("unknown")


def file_format(name: Column) -> Column:
    """G7."""
    return F.coalesce(lookup(F.lower(F.substring_index(name, ".", -1)), FORMATS), F.lit("unknown"))


def public_status(c: Column) -> Column:
    """G9."""
    return F.when(c == "uploaded", "queued").when(c.isin(STATUSES), c).otherwise("processing")


def is_file_name(c: Column) -> Column:
    """G10."""
    return c.rlike("\\.[\\p{L}\\p{N}_]{2,5}$")


def title_keywords(title: Column, most: int = 5) -> Column:
    """Up to five names in a title; none if it is a file name."""
    parts = F.filter(F.split(title, "[_\\-\\s]+"), lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$") & ~F.lower(p).isin(STOP_WORDS))
    korean = F.array_except(F.regexp_extract_all(title, F.lit("[가-힣]{2,}"), F.lit(0)), parts)
    return F.when(title.isNull() | (title == "") | is_file_name(title), F.array().cast("array<string>")).otherwise(F.slice(F.concat(parts, korean), 1, most))


def is_junk_name(c: Column, documents: bool = True) -> Column:
    """Paths, files, code and one-letter names; the form for chunks lets document suffixes pass."""
    parts = JUNK_PARTS + (JUNK_DOCS if documents else [])
    return c.isNull() | (F.length(c) < 2) | (c == "None") | c.startswith("/") | c.startswith(".") | any_of([F.contains(c, F.lit(p)) for p in parts])


def validity(start: Column, end: Column, as_of: Column) -> Column:
    """G12."""
    return F.when(start.isNull() & end.isNull(), "INDEFINITE").when(as_of < start, "NOT_YET_VALID").when(as_of > end, "EXPIRED").otherwise("VALID")


def snippet(c: Column, most: int = 200) -> Column:
    """G13."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def query_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def cache_key(kind: str, query: Column, filters: Column, k: int, graph: bool, version: int) -> Column:
    """One key for equal searches; filters is a map."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(filters))))
    return F.sha2(F.concat_ws(":", F.lit(kind), F.lower(F.trim(query)), F.coalesce(ordered, F.lit("{}")), F.lit(str(k)), F.lit(str(graph).lower()), F.lit(str(version))).cast("binary"), 256)


def l2_normalised(v: Column) -> Column:
    """A zero vector stays as it is."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def pruned_sparse(weights: Column, least: float = 0.1, most: int = 50) -> Column:
    """Map of token weights -> its heaviest entries, ties by token."""
    entries = F.filter(F.map_entries(weights), lambda e: e["value"] >= least)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(F.slice(ranked, 1, most), lambda e: F.struct(e["key"], e["value"])))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def json_part(c: Column) -> Column:
    """The fenced block, else the first brace to the last."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(.*?)```", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, "\\s+$", "")).otherwise(F.regexp_extract(c, "(?s)\\{.*\\}", 0))


def answer_sentences(c: Column) -> Column:
    """G21."""
    return F.filter(F.split(c, "(?<=[.!?。])\\s+"), lambda s: F.trim(s) != "")


def clean_text(c: Column) -> Column:
    """Blanks collapsed, at most one empty line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def truncated(c: Column, most: int = 100) -> Column:
    """Cut at the last blank if it is past half."""
    head = F.substring(c, 1, most)
    at = F.lit(most) - F.instr(F.reverse(head), " ")  # characters before the last blank
    cut = F.when((F.instr(head, " ") > 0) & (at > most / 2), F.expr("1").cast("int") * at).otherwise(F.lit(most))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substr(head, F.lit(1), cut.cast("int")), F.lit("...")))


def rough_tokens(c: Column) -> Column:
    """G26."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTS, PLAIN), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def char_grams(c: Column, least: int = 2, most: int = 20) -> Column:
    """All substrings of a token between two lengths."""
    sizes = F.sequence(F.lit(least), F.least(F.lit(most), F.length(c)))
    one = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))
    return F.when(F.length(c) < least, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(sizes, one)))


def highlighted(c: Column, term: str, size: int = 200, most: int = 3) -> Column:
    """Up to three fragments of `size` characters at most around a term, marked; the term is taken as it is written."""
    literal = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    side, apart = max(1, (size - len(term)) // 2 - 1), "[^\\p{L}\\p{N}_]"
    found = F.regexp_extract_all(c, F.lit(f"(?is)(?:\\A|.{{0,{side}}}{apart}){literal}(?:\\z|{apart}.{{0,{side}}})"), F.lit(0))
    # The fragments' pattern looks a whole side ahead of each character: only texts that have the term somewhere go there.
    found = F.when(c.isNull() | c.rlike(f"(?i){literal}"), found).otherwise(F.array().cast("array<string>"))
    return F.transform(F.slice(found, 1, most), lambda x: F.regexp_replace(x, f"(?i)(\\A|{apart})({literal})(?=\\z|{apart})", "$1<em>$2</em>"))
