"""Text normalisation, pre-tokenisation and text metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-tokenisation patterns of published tokenizers (Java syntax).
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GPT4 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,%d}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
O200K = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
MINISTRAL = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*"
    r"|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
#: Three splits in turn: digits, ideographs and kana, and the rest; what no alternative takes stays as a piece.
DEEPSEEK_MAIN = r"[!-/:-@\[-`{-~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
DEEPSEEK = [r"\p{N}{1,3}|\P{N}+", r"[\x{4E00}-\x{9FA5}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]+|[^\x{4E00}-\x{9FA5}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]+", rf"{DEEPSEEK_MAIN}|(?s:(?!{DEEPSEEK_MAIN}).)+"]
CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCT = r"!-/:-@\[-`{-~\p{P}"


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bert_pretokens(text: Column) -> Column:
    """Punctuation and ideographs by themselves, runs of other characters together, controls dropped."""
    return find_all(F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", ""), rf"[{PUNCT}]|[{CJK}]|[^\s{PUNCT}{CJK}]+")


def gpt2_pretokens(text: Column) -> Column:
    return find_all(text, GPT2)


def gpt4_pretokens(text: Column, max_digits: int = 3) -> Column:
    """max_digits 1 and 3 are two published variants."""
    return find_all(text, GPT4 % max_digits)


def o200k_pretokens(text: Column) -> Column:
    return find_all(text, O200K)


def ministral_pretokens(text: Column) -> Column:
    return find_all(text, MINISTRAL)


def deepseek_pretokens(text: Column) -> Column:
    pieces = F.array(text)
    cut = lambda pattern: lambda piece: find_all(piece, pattern)
    for pattern in DEEPSEEK:
        pieces = F.flatten(F.transform(pieces, cut(pattern)))
    return pieces


#: Bytes that aren't printable, and the code points from 256 on that stand for them in byte-level vocabularies.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES, _SHOWN = "".join(map(chr, _HIDDEN)), "".join(chr(256 + i) for i in range(len(_HIDDEN)))


def byte_alphabet(text: Column) -> Column:
    """A printable character for each UTF-8 byte."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _BYTES, _SHOWN)


def bytes_back(text: Column) -> Column:
    return F.decode(F.encode(F.translate(text, _SHOWN, _BYTES), "ISO-8859-1"), "UTF-8")


def clip_pretokens(text: Column) -> Column:
    return find_all(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), CLIP)


GLINER = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+(?:[-_][0-9A-Za-z_\x{80}-\x{10FFFF}]+)*|\S"


def gliner_words(text: Column) -> Column:
    return find_all(text, GLINER)


def char_class(c: Column) -> Column:
    return F.when(c.rlike(r"\A\p{L}"), "L").when(c.rlike(r"\A\p{N}"), "N").when(c.rlike(r"\A\s"), "Z").otherwise("other")


def siglip(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))


def lenient(text: Column) -> Column:
    """Lower case, anything but word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def garbage(text: Column) -> Column:
    """A word that makes up half of eight or more and occurs ten times, or a short unit repeated eight times on end anywhere.

    Words are counted by sorting them: one that occurs k times stands k - 1 places after itself.
    """
    stripped = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    words = F.filter(F.split(lenient(text), " "), lambda w: w != "")
    many = F.greatest(F.lit(10), F.floor(F.size(words) / 2).cast("int"))
    top = F.transform(F.array(F.struct(F.sort_array(words).alias("w"), many.alias("k"))), lambda s: F.exists(F.transform(s["w"], lambda w, i: F.get(s["w"], i + s["k"] - 1) == w), lambda same: F.coalesce(same, F.lit(False))))[0]
    dense = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    return (F.length(stripped) >= 12) & (((F.size(words) >= 8) & top) | ((F.length(dense) >= 24) & dense.rlike(r"(?s)(.{1,8}?)\1{7,}")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: What scoring takes out of a text, in this order.
MARKUP = [(r"!\[[^\]]*\]\([^)]*\)", " "), (r"<[^>]+>", " "), (r"(?md)^\s*#{1,6}\s*", ""), (r"(?md)^\s*\|?[\s:|-]{3,}\|?\s*$", " "), (r"\|", " "), (r"\*\*|__|\*|`", "")]


def strip_markup(text: Column) -> Column:
    """Images, tags, headings, rules and bars of tables, and emphasis go; line ends are told as "\n" only."""
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return text


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def outcome(ok: Column, raw: Column, moved: Column) -> Column:
    """error, neutral or unavailable: without the true text only a text that hardly moved can be told to be neutral."""
    return F.when(~ok, "error").when(raw, "neutral").when(moved.isNull(), "unavailable").when(moved <= 0.02, "neutral").otherwise("unavailable")


def passes_gate(text: Column, confidence: Column, least_bytes: Column, least_confidence: Column) -> Column:
    """A demand of 0 on confidence is none."""
    return (F.octet_length(text) >= least_bytes) & ((least_confidence <= 0) | (confidence >= least_confidence))


def starts(texts: Column) -> Column:
    """Where each text begins once they are joined by one character."""
    ahead = F.transform(texts, lambda _, i: F.aggregate(F.slice(texts, 1, i), F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 1))
    return ahead


def json_escape(text: Column) -> Column:
    """A JSON string: short forms where there are any, else four hex digits in lower case, as the value's own writer gives them."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    rare = out
    for c in range(32):
        rare = F.replace(rare, F.lit(chr(c)), F.lit("\\" + short[c] if c in short else f"\\u{c:04x}")) if c else F.regexp_replace(rare, "\\x00", "\\\\u0000")
    plain = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), F.when(out.rlike("[\\x00-\\x09\\x0B-\\x1F]"), rare).otherwise(plain), F.lit('"'))


def tokenizer_family(told: Column, declared: Column, model: Column, size: Column) -> Column:
    """0 WordPiece, 1 BPE, 2 SentencePiece: as declared, else by the model's name, else SentencePiece beyond 100,000 entries."""
    named = F.when(model.isin("gpt2", "bpe"), 1).when(model.isin("t5", "unigram", "spm", "llama"), 2)
    return F.when(told, declared).otherwise(F.coalesce(named, F.when(size > 100_000, 2).otherwise(0)))


def pair_lengths(a: Column, b: Column, room: int) -> tuple[Column, Column]:
    """Lengths left when the longer of two is trimmed first (ties trim a) until both fit in room."""
    over = F.greatest(a + b - room, F.lit(0))
    # The longer one gives up the difference first; what is left is shared, the first of each pair by a.
    gap_a, gap_b = F.least(F.greatest(a - b, F.lit(0)), over), F.least(F.greatest(b - a, F.lit(0)), over)
    rest = over - gap_a - gap_b
    return a - gap_a - F.ceil(rest / 2), b - gap_b - F.floor(rest / 2)
