"""Text measures and classifiers, as Column expressions on cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageforge.functions.base import WS, any_contains, count_of, hits, let, strip
from pageforge.functions.entities import clean_list, clean_text  # noqa: F401  (re-exported)

WORD_CHAR = r"\p{L}\p{N}_"

# Words that never count as keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had will would "
    "could should this that these those i you he she it we they"
).split()

# Language markers, matched as substrings. "et" and "en" are
# listed as they count; a marker listed twice counts twice.
LANGUAGE_MARKS = {
    "en": ["the", "and", "is", "in", "to", "of", "a", "that", "it", "with"],
    "es": ["el", "la", "de", "que", "y", "a", "en", "un", "es", "se"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "et", "en", "avoir"],
}

# Topics in tie-break order, six substrings each.
TOPIC_WORDS = {
    "technology": ["software", "computer", "programming", "tech", "ai", "machine learning"],
    "business": ["company", "market", "business", "finance", "economy", "investment"],
    "health": ["health", "medical", "doctor", "patient", "treatment", "medicine"],
    "sports": ["sport", "game", "team", "player", "match", "championship"],
    "science": ["research", "study", "scientist", "experiment", "discovery", "science"],
    "politics": ["government", "election", "political", "policy", "president", "congress"],
    "entertainment": ["movie", "music", "celebrity", "entertainment", "film", "actor"],
}

# Prompt categories in check order.
PROMPT_CATEGORY_WORDS = {
    "programming": ["algorithm", "function", "code", "programming", "python", "javascript"],
    "mathematics": ["calculate", "equation", "mathematics", "solve", "formula"],
    "logic": ["puzzle", "logic", "reasoning", "think", "problem"],
}
PROMPT_CATEGORY_DOMAINS = {"leetcode": "programming", "math": "mathematics"}

# Difficulty words and word-count bounds.
EASY_WORDS = ["simple", "basic", "easy", "beginner", "introduction"]
HARD_WORDS = ["complex", "advanced", "difficult", "challenging", "optimize", "efficient"]
EASY_BELOW, HARD_ABOVE = 50, 200

# Tags mined from prompt text, in list order.
TAG_WORDS = [
    "python", "javascript", "java", "c++", "c#", "ruby", "go", "rust", "php",
    "array", "list", "tree", "graph", "queue", "stack", "hash", "linked list",
    "sorting", "searching", "dynamic programming", "recursion", "greedy",
]
MAX_TAGS = 5

# Code marks per language, in check order, matched against
# lower-cased text. Marks with capitals ("System.out", "using System",
# "Console.WriteLine") can therefore never match and are left out.
CODE_MARKS = {
    "python": ["def ", "import ", "python", "print(", "if __name__"],
    "javascript": ["function", "var ", "let ", "const ", "console.log"],
    "java": ["public class", "public static"],
    "c++": ["#include", "int main", "std::", "cout"],
    "c#": ["public class"],
    "go": ["func ", "package ", "fmt."],
    "rust": ["fn ", "let mut", "println!"],
}

# Product categories by path substring, in check order.
URL_CATEGORY_WORDS = {
    "electronics": ["electronics", "computers", "phones", "tablets"],
    "clothing": ["clothing", "fashion", "apparel", "shoes"],
    "books": ["books", "literature", "reading"],
    "home": ["home", "furniture", "kitchen", "garden"],
    "sports": ["sports", "fitness", "outdoor"],
    "toys": ["toys", "games", "children"],
}

WORDS_PER_MINUTE = 200
EXCERPT_LENGTH = 200
SUMMARY_LENGTH = 300
SUMMARY_SENTENCES = 3
KEYWORD_COUNT = 10


def word_count(c: Column) -> Column:
    """Whitespace-separated tokens; null and empty give 0."""
    return F.coalesce(F.regexp_count(c, F.lit(rf"(?U)[^{WS[1:-1]}]+")), F.lit(0))


def clean_word_count(c: Column) -> Column:
    """``word_count`` of cleaned text, whose only white space is single spaces. Where a
    removed control character left spaces side by side or at an end, words are counted."""
    uneven = c.contains("  ") | c.startswith(" ") | c.endswith(" ")
    return F.when(uneven, word_count(c)).when(c != "", count_of(c, " ") + 1).otherwise(F.lit(0))


def reading_minutes(words: Column) -> Column:
    """Minutes for a word count, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(words / F.lit(float(WORDS_PER_MINUTE))).cast("int"))


def reading_time(c: Column) -> Column:
    return F.when(c != "", reading_minutes(word_count(c))).otherwise(F.lit(0))


def _fill(sentences: Column, limit: int) -> Column:
    """Append ``sentence + '. '`` while the bare sentence still fits; stop at the first misfit."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["text"]) + F.length(sentence) <= limit
        return (
            F.when(acc["full"], acc)
            .when(fits, F.struct(F.concat(acc["text"], sentence, F.lit(". ")).alias("text"), F.lit(False).alias("full")))
            .otherwise(F.struct(acc["text"].alias("text"), F.lit(True).alias("full")))
        )

    return F.aggregate(sentences, start, add, lambda acc: strip(acc["text"]))


def excerpt(c: Column) -> Column:
    """Leading sentences up to 200 characters; null when none fits or the text is empty."""
    filled = _fill(F.split(c, r"\. "), EXCERPT_LENGTH)
    return F.when(c != "", F.nullif(filled, F.lit("")))


def summary(c: Column) -> Column:
    """First three sentences up to 300 characters; null when there are none."""
    pieces = F.filter(F.split(c, r"[.!?]+"), lambda s: s.rlike(rf"(?U)[^{WS[1:-1]}]"))
    first = F.transform(F.slice(pieces, 1, SUMMARY_SENTENCES), strip)
    return F.when(c != "", F.nullif(_fill(first, SUMMARY_LENGTH), F.lit("")))


def slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), rf"(?U)[^{WORD_CHAR}{WS[1:-1]}\-]", "")
    dashed = F.regexp_replace(kept, rf"(?U)[{WS[1:-1]}_\-]+", "-")
    return F.when(title != "", F.trim(dashed, F.lit("-")))


def keyword_candidates(lowered: Column) -> Column:
    """Words of three or more plain letters that are no stop words, in order of use.
    Stop words are passed over by the pattern itself."""
    stop = "|".join(w for w in STOP_WORDS if len(w) >= 3)
    pattern = rf"(?<![{WORD_CHAR}])(?!(?:{stop})(?![{WORD_CHAR}]))[a-z]{{3,}}+(?![{WORD_CHAR}])"
    return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))


def keywords(content: Column, title: Column) -> Column:
    """Up to ten words used more than once, most used first, ties by first use.

    Counting happens inside the row: words are sorted with their positions and
    equal neighbours folded, keeping a ten-entry leader list. No shuffle, no
    quadratic pass, whatever the length of the text.
    """
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), content))
    kept = F.transform(keyword_candidates(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    leaders_type = "array<struct<rank:int,i:int,w:string>>"
    start = F.struct(
        F.lit(None).cast("string").alias("w"),
        F.lit(0).alias("i"),
        F.lit(0).alias("n"),
        F.array().cast(leaders_type).alias("leaders"),
    )

    def leaders(run: Column) -> Column:
        entry = F.struct((-run["n"]).alias("rank"), run["i"].alias("i"), run["w"].alias("w"))
        merged = F.slice(F.sort_array(F.concat(run["leaders"], F.array(entry))), 1, KEYWORD_COUNT)
        return F.when(run["n"] > 1, merged).otherwise(run["leaders"])

    def fold(run: Column, p: Column) -> Column:
        return F.when(
            run["w"].eqNullSafe(p["w"]),
            F.struct(run["w"].alias("w"), run["i"].alias("i"), (run["n"] + 1).alias("n"), run["leaders"].alias("leaders")),
        ).otherwise(
            F.struct(p["w"].alias("w"), p["i"].alias("i"), F.lit(1).alias("n"), leaders(run).alias("leaders"))
        )

    return F.aggregate(
        F.sort_array(kept), start, fold, lambda run: F.transform(leaders(run), lambda e: e["w"])
    )


def language(content: Column) -> Column:
    """Guess en, es or fr by marker substrings; empty and null content give en."""

    def guess(found: Column) -> Column:
        en, es, fr = found["en"], found["es"], found["fr"]
        return F.when((en > es) & (en > fr), "en").when(es > fr, "es").when(fr > 0, "fr").otherwise("en")

    def count(lowered: Column) -> Column:
        return let(F.struct(*[hits(lowered, marks).alias(k) for k, marks in LANGUAGE_MARKS.items()]), guess)

    return let(F.lower(F.coalesce(content, F.lit(""))), count)


def topic(content: Column, title: Column) -> Column:
    """Topic with most keyword substrings; ties go to the first listed; none gives general."""

    def best(text: Column) -> Column:
        scored = [
            F.struct(hits(text, words).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("topic"))
            for k, (name, words) in enumerate(TOPIC_WORDS.items())
        ]
        return let(F.array_max(F.array(*scored)), lambda b: F.when(b["score"] > 0, b["topic"]).otherwise("general"))

    return let(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), content)), best)


def _first_match(text: Column, groups: dict[str, list[str]]) -> Column:
    matched = None
    for name, words in groups.items():
        test = any_contains(text, words)
        matched = F.when(test, name) if matched is None else matched.when(test, name)
    return matched


def prompt_category(text: Column, domain: Column) -> Column:
    by_domain = F.lit("general")
    for mark, name in reversed(PROMPT_CATEGORY_DOMAINS.items()):
        by_domain = F.when(domain.contains(mark), name).otherwise(by_domain)
    return F.coalesce(let(F.lower(text), lambda t: _first_match(t, PROMPT_CATEGORY_WORDS)), by_domain)


def difficulty(text: Column) -> Column:
    words = word_count(text)
    by_words = let(
        F.lower(text), lambda t: F.when(any_contains(t, EASY_WORDS), "easy").when(any_contains(t, HARD_WORDS), "hard")
    )
    by_length = F.when(words < EASY_BELOW, "easy").when(words > HARD_ABOVE, "hard").otherwise("medium")
    return F.coalesce(by_words, by_length)


def mined_tags(text: Column) -> Column:
    def mine(lowered: Column) -> Column:
        found = [F.when(lowered.contains(w), w.replace(" ", "-")) for w in TAG_WORDS]
        return F.slice(F.array_compact(F.array(*found)), 1, MAX_TAGS)

    return let(F.lower(text), mine)


def code_language(text: Column) -> Column:
    return let(F.lower(text), lambda t: _first_match(t, CODE_MARKS))


def url_category(path: Column) -> Column:
    return let(F.lower(path), lambda p: _first_match(p, URL_CATEGORY_WORDS))


def split_tags(c: Column) -> Column:
    """Comma-separated text to trimmed, non-empty tags."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def tag_list(items: Column) -> Column:
    """Array form of tags: empty elements dropped, the rest cleaned; null when nothing is given."""
    given = F.filter(items, lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(items) > 0, clean_list(given))


def blog_category(category: Column, tags: Column, domain: Column) -> Column:
    """Given category, else the first tag, else the domain."""
    return F.coalesce(F.nullif(category, F.lit("")), F.get(tags, F.lit(0)), domain)
