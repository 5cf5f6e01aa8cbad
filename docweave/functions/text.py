"""Text expressions: tokenizers, sentences, cleaning, readability. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word, and the suffixes and stop words of the two languages.
WORD = "[0-9a-zA-Z가-힣]+"
JOSA = ("으로써", "에게서", "이라도", "에서는", "에서도", "으로는", "이라는", "하려면", "으로", "에서", "에게", "까지", "부터", "이나", "보다", "마다", "라도", "이란", "하는", "한다", "된다", "되는", "이며", "와의", "과의", "이라", "라는", "은", "는", "이", "가", "을", "를", "에", "도", "만", "와", "과", "로", "의")
KOREAN_STOP_WORDS = ("그", "저", "것", "것을", "것은", "것이", "이것", "그것", "무엇", "무엇을", "무엇입니까", "어떻게", "하는", "및", "또는")
#: The public Snowball list of English stop words.
ENGLISH_STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """Sliding character n-grams of each word; a word of at most n characters is kept whole."""
    return F.flatten(F.transform(simple_tokens(text), lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: w.substr(i, F.lit(n))))))


def bigram_tokens(text: Column) -> Column:
    return ngrams(text, 2)


TOKENIZERS = {"simple": simple_tokens, "bigram": bigram_tokens}


def tokens(text: Column, name: str) -> Column:
    """An unknown name is an error: an index and its queries must share one tokenizer."""
    return TOKENIZERS[name](text)


def word_tokens(text: Column, name: str) -> Column:
    """array<struct<token, word>>: a token carries the word that it comes from."""
    words = simple_tokens(text)
    if name == "simple":
        return F.transform(words, lambda w: F.struct(w.alias("token"), w.alias("word")))
    if name != "bigram":
        raise KeyError(name)
    return F.flatten(F.transform(words, lambda w: F.transform(bigram_tokens(w), lambda t: F.struct(t.alias("token"), w.alias("word")))))


def stem(word: Column) -> Column:
    """Takes off one trailing particle, the longest that leaves two characters."""
    out = word
    for suffix in reversed(JOSA):
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 2), word.substr(F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?。！？])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def clean_text(text: Column) -> Column:
    """Without control characters other than tab, newline and carriage return."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def readable_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and common marks once runs of one character count twice at most
    and each (cid:N) counts as one bad character."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\(cid:\d+\)", "�"), r"(.)\1{2,}", "$1$1")
    good = F.length(F.regexp_replace(flat, r"[^\p{L}\p{N}\s.,;:!?'\"()\-]", ""))
    return F.when(F.length(flat) > 0, good / F.length(flat)).otherwise(F.lit(0.0))


def cid_garbage_ratio(text: Column) -> Column:
    count = F.regexp_count(text, F.lit(r"\(cid:\d+\)"))
    rest = F.length(F.regexp_replace(text, r"\(cid:\d+\)", ""))
    return F.when(count + rest > 0, count / (count + rest)).otherwise(F.lit(0.0))


def join_wrapped(first: Column, second: Column) -> Column:
    """Two lines as one: without a space where a word goes on from Hangul to Hangul."""
    glued = first.rlike("[가-힣ᄀ-ᇿ㄰-㆏]$") & second.rlike("^[가-힣ᄀ-ᇿ㄰-㆏]")
    return F.when(glued, F.concat(first, second)).otherwise(F.concat_ws(" ", first, second))


def document_title(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"\s+", "")


def opens_with(text: Column, markers: tuple[str, ...]) -> Column:
    """The first marker that the text opens with, or null."""
    head = F.regexp_replace(text, r"^\s+", "")
    return F.coalesce(*[F.when(head.startswith(m), F.lit(m)) for m in markers])
