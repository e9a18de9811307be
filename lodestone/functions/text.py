"""Text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_WORDS, CHUNK_STEP, PREVIEW_CHARS = 500, 450, 500

# The four substitutions of Markdown stripping, in order, and their replacements.
MARKDOWN = [(r"#+\s*", ""), (r"\*\*|__|\\+|_|~~", ""), (r"`{1,3}[^`]*`{1,3}", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1")]
TAG = r"<[^>]+>"
WORD = "[a-z0-9]+"
URL = r"^(https?://|git@)[a-zA-Z0-9._\-/:%@]+(\.git)?$"


def tokenize(text: Column) -> Column:
    """ASCII words and numbers of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_markdown(text: Column) -> Column:
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def document_type(name: Column) -> Column:
    """MARKDOWN, HTML or TEXT from the extension; no dot means text."""
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("txt")
    return F.when(ext.isin("md", "markdown"), "MARKDOWN").when(ext == "html", "HTML").otherwise("TEXT")


def plain_text(name: Column, content: Column) -> Column:
    kind = document_type(name)
    return F.when(kind == "MARKDOWN", strip_markdown(content)).when(kind == "HTML", strip_html(content)).otherwise(content)


def chunks(text: Column) -> Column:
    """Overlapping chunks of 500 words, one every 450 words: ceil(words / 450) of them, none for a text without words."""
    w = words(text)
    n = F.ceil(F.size(w) / CHUNK_STEP).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * CHUNK_STEP + 1, CHUNK_WORDS), " "))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def text_preview(text: Column) -> Column:
    return F.array_join(F.slice(words(text), 1, CHUNK_WORDS), " ")


def chunk_previews(text: Column) -> Column:
    return F.transform(chunks(text), lambda c: F.substring(c, 1, PREVIEW_CHARS))


def valid_url(url: Column) -> Column:
    return url.rlike(URL)


def readme(name: Column, language: Column, url: Column) -> Column:
    """The text made for a repository that has no documents yet (fixed value: its layout)."""
    n, lang, u = F.coalesce(name, F.lit("Repository")), F.coalesce(language, F.lit("Unknown")), F.coalesce(url, F.lit(""))
    return F.format_string("# %s\n\nLanguage: %s\nURL: %s\n\nThis is an auto-discovered README document.\n", n, lang, u)


def entity_key(name: Column) -> Column:
    """One key for all spellings of a name."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def highlight(text: Column, pattern: str, before: str = "<em>", after: str = "</em>") -> Column:
    return F.regexp_replace(text, f"(?i)({pattern})", f"{before}$1{after}")
