"""Text as Column expressions: normalisation, previews, slugs, HTML, tolerant JSON."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks, and that character; then the marks, to drop."""
    source, target = [], []
    marks = []
    for code in (c for c in range(0xC0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source + marks), "".join(target)


_SOURCE, _TARGET = _folding()


def fold_accents(text: Column) -> Column:
    """Letters without their marks, whatever the script.  Plain ASCII isn't looked up letter by letter."""
    return _translated(text, _SOURCE, _TARGET)


def _translated(text: Column, source: str, target: str) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)


def normalize(text: Column) -> Column:
    """Accents folded, lower case, typographic quotes plain, everything but word characters and apostrophes one space."""
    plain = _translated(text, "’‘" + _SOURCE, "''" + _TARGET)
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_']+", " "))


def token_estimate(text: Column) -> Column:
    """Four characters to a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def preview(text: Column, size: int = 90) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("…"))).otherwise(flat)


def slug(text: Column, size: int = 60, default: str = "org") -> Column:
    ascii_only = F.regexp_replace(fold_accents(text), r"[^\x00-\x7F]", "")
    joined = F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9]+", "-")
    cut = F.left(F.regexp_replace(joined, r"^-+|-+$", ""), F.lit(size))
    return F.when(cut == "", default).otherwise(cut)


def content_key(tenant: Column, content: Column, filename: Column) -> Column:
    """Where a blob is kept: tenant / first two hex digits / digest and a safe suffix; the name itself is never a path."""
    digest = F.sha2(content, 256)
    suffix = F.left(F.lower(F.regexp_extract(filename, r"(\.[A-Za-z0-9]+)$", 1)), F.lit(10))
    return F.concat_ws("/", tenant, F.left(digest, F.lit(2)), F.concat(digest, F.when(suffix == "", ".bin").otherwise(suffix)))


# The entities that regulation pages use, accents folded; they are resolved in this order.
ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "'", "&laquo;": '"',
    "&raquo;": '"', "&eacute;": "e", "&egrave;": "e", "&agrave;": "a", "&ccedil;": "c", "&ocirc;": "o", "&ecirc;": "e", "&ugrave;": "u",
}
#: What isn't text in a page: scripts and styles with their content, tags, entities (one that an ampersand was escaped in, too).
MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<[^>]+>|&(?:amp;)?(?:[a-z]+|#[0-9]+);"


def _meaning(token: Column) -> Column:
    """What a piece of markup stands for in plain text."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    decoded = lambda e: F.coalesce(F.try_element_at(known, e), F.when(e.rlike("^&#[0-9]+;$"), " ").otherwise(e))
    inner = F.concat(F.lit("&"), F.substr(token, F.lit(6)))
    entity = F.when(token.rlike("^&amp;."), F.when(inner.isin("&nbsp;", "&amp;"), inner).otherwise(decoded(inner))).otherwise(decoded(token))
    line_end = token.rlike(r"(?i)^(?:</(?:p|div|br|tr|h[1-6]|li)\s*>|<br\s*/?>)$")
    return F.when(F.startswith(token, F.lit("&")), entity).when(token.rlike("(?is)^<(?:script|style).*</"), " ").when(line_end, "\n").otherwise("")


def html_lines(html: Column) -> Column:
    """The text lines of a page, as an array: the page is cut at its markup, which becomes what it means, and what is left is joined.

    Scripts and styles are a space, ends of blocks and breaks end a line, other tags are nothing, entities their character.
    """
    between, markup = F.split(html, MARKUP, -1), F.transform(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0)), _meaning)
    text = F.array_join(F.zip_with(between, markup, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t\u00a0\r]+", " ")))
    return F.filter(lines, lambda x: x != "")


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def header_safe(text: Column) -> Column:
    """One line, so that a value can't add mail headers."""
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " "))


def article_number(reference: Column) -> Column:
    """The number in "Article N", null without one."""
    return F.nullif(F.regexp_extract(reference, r"(?i)Article\s+(\d+)", 1), F.lit("")).try_cast("int")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a plain string; where there is none, nothing is copied."""
    counted = F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")
    return F.when(F.contains(text, term), counted).otherwise(0)


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer: fences stripped, else from the first brace to the last; null if neither parses."""
    bare = F.trim(F.regexp_replace(answer, r"(?m)^\s*```(?:json)?\s*$", ""))
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.when(bare.startswith("{"), bare)), F.try_parse_json(F.nullif(inner, F.lit(""))))


def json_value(answer: Column) -> Column:
    """The same for objects or arrays."""
    bare = F.trim(F.regexp_replace(answer, r"(?m)^\s*```(?:json)?\s*$", ""))
    inner = F.regexp_extract(answer, r"(?s)([\[{].*[\]}])", 1)
    return F.coalesce(F.try_parse_json(F.when(bare.rlike(r"^[\[{]"), bare)), F.try_parse_json(F.nullif(inner, F.lit(""))))


def quoted_body(prompt: Column) -> Column:
    """What stands between the first two triple quotes, the whole prompt without them."""
    parts = F.split(prompt, '"""')
    return F.when(F.size(parts) >= 2, F.get(parts, 1)).otherwise(prompt)


def valid_ip(value: Column) -> Column:
    """An IPv4 or IPv6 address, else null; of a forwarding chain the first hop.

    An IPv6 address is eight groups, or fewer around one "::"; its last two may
    be written as an IPv4 address, and a zone may follow.
    """
    first = F.trim(F.split_part(value, F.lit(","), F.lit(1)))
    v4 = r"((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
    groups = F.regexp_replace(F.regexp_replace(first, "%[^%]+$", ""), "(?<=:)" + v4, "0:0")
    shaped = groups.rlike(r"^(::|[0-9A-Fa-f]{1,4}(:|$))") & groups.rlike(r"^(:{0,2}[0-9A-Fa-f]{1,4})*(::)?$") & (F.regexp_count(groups, F.lit("::")) <= 1)
    n = F.regexp_count(groups, F.lit("[0-9A-Fa-f]+"))
    v6 = shaped & F.contains(groups, F.lit(":")) & F.when(F.contains(groups, F.lit("::")), n <= 7).otherwise(n == 8)
    return F.when(first.rlike("^" + v4) | v6, first)


# Payload keys that are never logged.
SECRET_KEYS = ("password", "new_password", "current_password", "token", "access_token")


def redact(payload: Column) -> Column:
    """A string map with the values of secret keys blanked."""
    return F.transform_values(payload, lambda k, v: F.when(k.isin(*SECRET_KEYS), F.lit("[REDACTED]")).otherwise(v))


# Passwords that are never taken, bounds of the length, and the classes of which three must be there.
COMMON_PASSWORDS = ("password", "motdepasse", "azertyuiop", "123456789012", "qwertyuiop")
PASSWORD_LENGTH = (12, 128)
PASSWORD_CLASSES = ("[a-z]", "[A-Z]", r"(?U)\d", r"(?U)[^\w\s]")


def password_accepted(password: Column) -> Column:
    """12 to 128 characters, three of four character classes, not a common word."""
    classes = sum((password.rlike(c).cast("int") for c in PASSWORD_CLASSES), F.lit(0))
    return F.length(password).between(*PASSWORD_LENGTH) & (classes >= 3) & ~F.lower(password).isin(*COMMON_PASSWORDS)


def excerpt(identifier: Column, section: Column, text: Column) -> Column:
    """How a passage is shown to the model."""
    return F.concat(F.lit("["), identifier, F.lit(" · "), section, F.lit("]\n"), text)
