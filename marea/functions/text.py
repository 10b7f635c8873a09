"""Text expressions: normalisation, tokens, keys, topics and label rules."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII and the ASCII that their compatibility decomposition holds: those of one character, and longer."""
    one, more = {}, {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if plain:
            (one if len(plain) == 1 else more)[c] = plain
    return one, more


def _ranges(characters: list[str]) -> str:
    """A pattern of one of these characters, as few ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


_ONE, _MORE = _folded()
ACCENTED, PLAIN = "".join(_ONE), "".join(_ONE.values())
#: The longer ones as a pattern, and as one text that a map is made of.
_LONGER, _SPELLED = _ranges(list(_MORE)), "\x02".join(f"{c}\x01{plain}" for c, plain in _MORE.items())

# Markers that stand for a missing text.
EMPTY_MARKERS = ("", "nan", "none", "null", "nat")

# Labels without meaning, after normalisation.
GENERIC_LABELS = ("", "nan", "none", "na", "n/a", "sin comentario", "sin comentarios", "sincomentario", "sincomentarios", "no comment", "no comments")

#: A letter or digit that none of them has.
_TELLING = "[" + "".join(c + c.upper() for c in string.ascii_lowercase + string.digits if c not in "".join(GENERIC_LABELS)) + "]"

# Words that make no hot term.
TERM_STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "con", "sin", "por", "para", "que", "una", "uno", "unos", "unas", "this", "that", "from", "with", "without",
    "error", "issue", "incidencia", "incidente", "cliente", "app", "aplicacion", "mobile", "banca", "sintoma", "hora", "mensaje", "servicio", "usuario",
    "acotamiento", "identifica", "proceder", "realizar", "realiza", "caso", "soporte", "inc", "ird", "cuenta", "cuentas", "clientes", "sistema", "cambios",
    "momento", "portal", "desde", "tiene", "medio", "tiempo", "telefono", "usuarios", "ventana",
)

# Words that make no axis label.
AXIS_STOPWORDS = ("de", "del", "la", "el", "los", "las", "con", "sin", "por", "para", "que", "una", "uno", "unos", "unas", "and", "the")

# Words that make no term of a comment topic.
TOPIC_STOPWORDS = (
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "más", "pero", "sus", "le", "ya",
    "o", "este", "sí", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante",
    "todos", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "mí", "antes", "algunos", "qué", "unos", "yo", "otro", "otras", "otra", "él",
    "tanto", "esa", "estos", "mucho", "quienes", "nada", "muchos", "cual", "poco", "ella", "estar", "estas", "algunas", "algo", "nosotros", "mi",
)

# Tones and the expressions that show them.
TONES = {
    "frustracion": ["no puedo", "no deja", "error", "falla", "fallo", "bloquea", "se queda", "lento", "intermitente", "timeout"],
    "urgencia": ["urge", "urgente", "ya", "hoy", "ahora"],
    "confusion": ["no entiendo", "como", "donde", "por que", "qué"],
    "aprecio": ["excelente", "muy bien", "genial", "gracias", "práctica", "facil", "rápida"],
    "sugerencia": ["podrian", "deberian", "seria bueno", "me gustaria", "falta"],
}

SPACES = r"(?U)\s+"
#: What a text has where SPACES may change it: a white space but for single blanks, or a character that may be one.
_SPACED = r"[\t-\r]|  |[^\x00-\x7F]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(value: Column) -> Column:
    """Trimmed text with single spaces; a missing value is the empty text."""
    own = F.coalesce(value.cast("string"), F.lit(""))
    return F.trim(F.when(own.rlike(_SPACED), F.regexp_replace(own, SPACES, " ")).otherwise(own))


def known(value: Column) -> Column:
    """text(), or null where it is a marker of a missing value."""
    clean = text(value)
    return F.when(~F.lower(clean).isin(*EMPTY_MARKERS), clean)


def fold(value: Column) -> Column:
    """Lower case without accents or other signs beyond ASCII; letters and signs that hold ASCII ones fold to these, as they are."""
    table = F.str_to_map(F.lit(_SPELLED), F.lit("\x02"), F.lit("\x01"))

    def plain(lower: Column) -> Column:
        # most texts have none of the characters that fold to several: those that one has are replaced one by one
        longer = F.array_distinct(F.regexp_extract_all(lower, F.lit(_LONGER), F.lit(0)))
        whole = F.aggregate(longer, lower, lambda t, c: F.replace(t, c, F.try_element_at(table, c)))
        return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.regexp_replace(F.translate(whole, ACCENTED, PLAIN), r"[^\x00-\x7F]", ""))

    return once(F.lower(text(value)), plain)


def comparable(value: Column) -> Column:
    """Lower case, single spaces: the text that comments are compared by."""
    return F.lower(text(value))


def letters(value: Column) -> Column:
    """Lower case with anything but letters, digits and spaces turned into spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), SPACES, " "))


def phrase(value: Column) -> Column:
    """fold() with anything but letters, digits and spaces turned into spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9 ]+", " "), " +", " "))


def attribution(value: Column) -> Column:
    """fold() that keeps > as the border between the parts of a topic."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9> /]+", " "), " +", " "))


def tokens(value: Column, least: int = 4, stop: tuple[str, ...] = TERM_STOPWORDS) -> Column:
    """Runs of at least `least` letters or digits, without stop words and numbers."""
    found = F.regexp_extract_all(fold(value), F.lit(f"([a-z0-9]{{{least},}})"), 1)
    return F.filter(found, lambda t: wanted(t, stop))


def wanted(token: Column, stop: tuple[str, ...] = TERM_STOPWORDS) -> Column:
    """Whether a word is none of the stop words and no number."""
    return ~token.isin(*stop) & ~token.rlike("^[0-9]+$")


def words(value: Column, least: int = 4) -> Column:
    """The distinct runs of tokens(), stop words and numbers too, in any order: only words beyond ASCII are folded, each once."""
    low, none = F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.array().cast("array<string>")
    plain = F.lit(f"([a-z0-9]{{{least},}})")
    ascii_ = lambda t: F.octet_length(t) == F.length(t)

    def both(w: Column) -> Column:
        # folding goes character by character, so what surrounds a word changes nothing in it
        other = F.array_join(F.filter(w, lambda t: ~ascii_(t)), " ")
        return F.concat(F.filter(w, lambda t: ascii_(t) & (F.length(t) >= least)), F.coalesce(F.regexp_extract_all(fold(other), plain, F.lit(1)), none))

    mixed = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9\x{80}-\x{10FFFF}]++)"), F.lit(1)))
    return F.array_distinct(F.when(ascii_(low), F.regexp_extract_all(low, plain, F.lit(1))).otherwise(once(mixed, both)))


def axis_tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(phrase(value), F.lit("([a-z0-9]{3,})"), 1), lambda t: ~t.isin(*AXIS_STOPWORDS)))


def stem(value: Column) -> Column:
    """A term without its plural ending."""
    base = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(F.endswith(base, F.lit("es")) & (F.length(base) > 4), base.substr(F.lit(1), F.length(base) - 2)).when(F.endswith(base, F.lit("s")) & (F.length(base) > 3), base.substr(F.lit(1), F.length(base) - 1)).otherwise(base)


def token_set(value: Column) -> Column:
    """Comma-separated tokens as a sorted set, so that order and repeats don't matter."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.trim(t))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != ""))), ",")


def split_list(value: Column, separators: str = r"[\n,;|]+") -> Column:
    """The distinct non-empty parts of a listing, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), separators), lambda t: text(t)), lambda t: t != ""))


def topic(lever: Column, sublever: Column) -> Column:
    """lever > sublever, or the one that is there."""
    a, b = text(lever), text(sublever)
    return F.when(b == "", a).when(a == "", b).otherwise(F.concat(a, F.lit(" > "), b))


def axis_value(topic_: Column, sub: bool) -> Column:
    """The part of a topic before (or, for the sub-axis, after) its first >."""
    parts = F.split(F.coalesce(topic_, F.lit("")), ">", 2)
    return F.trim(F.coalesce(F.get(parts, 1), F.lit(""))) if sub else F.trim(F.get(parts, 0))


def generic(value: Column) -> Column:
    """Whether a label says nothing: itself, or every part between > signs."""
    parts = F.split(attribution(value), ">")
    # letters and digits stay what they are, so one that no such label has tells enough
    return F.when(value.cast("string").rlike(_TELLING), False).otherwise(F.forall(parts, lambda p: F.trim(p).isin(*GENERIC_LABELS)))


def tones(value: Column) -> Column:
    """The tones whose expressions occur in a text, sorted."""
    hit = lambda clean: F.array_compact(F.array(*(F.when(F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(clean, w)), F.lit(name)) for name, words in sorted(TONES.items()))))
    # bound by a lambda: the text is cleaned once, not for each expression
    return F.get(F.transform(F.array(letters(value)), hit), F.lit(0))


def header(name: str) -> str:
    """A column header in lower-case ASCII words."""
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", " ", plain).strip()


def category(value: Column, canonical: dict[str, str] | None = None) -> Column:
    """A category in its canonical spelling, looked up without accents and case; missing values are empty."""
    clean = text(value)
    key = F.when(F.lower(clean).isin(*EMPTY_MARKERS, "<na>"), "").otherwise(fold(clean))
    names = {k: v for k, v in (canonical or {}).items()}
    spelled = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key) if names else F.lit(None).cast("string")
    return F.when(key == "", "").otherwise(F.coalesce(spelled, clean))


def slug(value: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def url(base: Column, record: Column) -> Column:
    """base/record without doubled slashes; null where a part is missing."""
    a, b = F.regexp_replace(text(base), "/+$", ""), text(record)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("/"), b))


def is_url(value: Column, base: Column | None = None) -> Column:
    """An http address that is more than the base address alone."""
    clean = text(value)
    ok = clean.rlike("(?i)^https?://")
    return ok if base is None else ok & (F.regexp_replace(clean, "/+$", "") != F.regexp_replace(text(base), "/+$", ""))
