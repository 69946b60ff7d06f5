"""Text rules: normal forms, keys, names, types of values, codes and prose."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _decomposing() -> tuple[str, str]:
    """All letters that are one letter with marks (nonspacing ones), and that letter."""
    marked, plain = [], []
    for i in range(0xA0, 0x30000):
        parts = unicodedata.normalize("NFD", chr(i))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if parts != chr(i) and len(base) == 1 and base[0] != chr(i):
            marked.append(chr(i))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _decomposing()

# Words that label a value, by kind of field. Later kinds win.
LABELS = {
    "nombre": ["nombre", "apellidos", "apellido", "razón social", "razon social", "titular", "cliente", "paciente", "alumno", "empleado"],
    "dni": ["dni", "nif", "nie", "cif", "documento", "identificación", "identificacion", "id", "pasaporte", "nº", "n.º", "núm", "num"],
    "fecha": [
        "fecha", "fecha de nacimiento", "fecha nacimiento", "fecha emisión", "fecha emision", "fecha expedición", "fecha expedicion",
        "fecha validez", "fecha inicio", "fecha fin", "nacido", "f. nacimiento",
    ],
    "direccion": ["dirección", "direccion", "domicilio", "calle", "población", "poblacion", "provincia", "código postal", "codigo postal", "cp", "localidad", "municipio", "residencia"],
    "telefono": ["teléfono", "telefono", "tlf", "tfno", "móvil", "movil", "contacto", "tel", "fax"],
    "email": ["email", "correo", "e-mail", "mail", "correo electrónico", "correo electronico"],
    "importe": [
        "importe", "total", "subtotal", "base imponible", "iva", "irpf", "neto", "bruto", "cantidad", "precio", "coste", "costo", "saldo", "cuota",
        "cuantía", "cuantia", "importe total", "total factura", "a pagar", "a ingresar", "import",
    ],
    "banco": ["iban", "bic", "swift", "cuenta", "entidad", "oficina", "dc", "ccc", "cuenta corriente", "número de cuenta", "numero de cuenta", "titular cuenta", "banco", "caja"],
    "referencia": [
        "referencia", "ref", "nº expediente", "expediente", "nº factura", "factura nº", "factura no", "albarán", "albaran", "pedido", "código", "codigo",
        "matrícula", "matricula", "registro",
    ],
    "firma": ["firma", "firmado", "fdo", "sello", "conforme", "recibí", "recibi"],
}
KEYWORDS = {word: kind for kind, words in LABELS.items() for word in words}

# Short words that are no codes.
STOPWORDS = [
    "EL", "LA", "LOS", "LAS", "UN", "UNA", "UNOS", "UNAS", "DE", "DEL", "Y", "E", "O", "U", "EN", "A", "AL", "SE", "ES", "SU", "SUS", "LE", "LO", "NA",
    "POR", "CON", "SIN", "QUE", "NO", "SI", "ETA", "SB", "LN", "N", "RO", "AC",
]

# Shapes of values, in the order in which they are tried.
SHAPES = [
    ("email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"),
    ("date", r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}$"),
    ("dni", r"^[0-9]{7,8}[A-Za-z]$"),
    ("phone", r"^\+?[0-9][0-9\s\-.]{6,14}[0-9]$"),
    ("currency", r"^[0-9.,]+\s*[€$]$|^[€$]\s*[0-9.,]+$"),
    ("number", r"^[0-9.,]+$"),
]
CODE = r"^[A-Za-z]{1,3}(\.[A-Za-z0-9]{1,3}){0,3}$"
DECORATION = r"^[\s\-/_.|·•…¥*]+$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body, or a function within it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unmarked(s: Column) -> Column:
    """Without the marks of letters and without combining marks, of which text of single bytes has none."""
    return bound(s, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.regexp_replace(F.translate(t, MARKED, PLAIN), "\\p{Mn}", "")))


def normal_anchor(s: Column) -> Column:
    """For anchors: no marks, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unmarked(F.coalesce(s, F.lit("")))), "[\\s\\x1c-\\x1f]+", " "))


def normal_value(s: Column, also: str = "") -> Column:
    """For values: no marks, lower case, letters and digits only, and characters of ``also`` (as in a class of a regular expression)."""
    return F.regexp_replace(unmarked(F.lower(F.coalesce(s, F.lit("")))), f"[^\\p{{L}}\\p{{N}}{also}]", "")


def _each(words: Column, one: Callable[[Column], Column], mark: str, whole: Callable[[Column], Column], between: str) -> Column:
    """``one`` of each word of a list. The words are normalised as one text, joined by a character that no normal form changes or holds, and split again, unless one of them holds it itself."""
    text = F.array_join(F.transform(words, lambda w: F.coalesce(w, F.lit(""))), mark)
    return bound(F.split(whole(text), between), lambda ns: F.when(F.size(ns) == F.size(words), ns).otherwise(F.transform(words, lambda w: one(w))))


def normal_anchors(words: Column) -> Column:
    """normal_anchor of each word of a list."""
    return _each(words, normal_anchor, "\x01", normal_anchor, " ?\x01 ?")


def normal_values(words: Column) -> Column:
    """normal_value of each word of a list."""
    return _each(words, normal_value, "\n", lambda s: normal_value(s, "\\n"), "\n")


def normal_label(s: Column, also: str = "") -> Column:
    """For labels: as values, but full stops and colons stay, and characters of ``also`` (as in a class of a regular expression)."""
    return F.regexp_replace(unmarked(F.lower(F.coalesce(s, F.lit("")))), f"[^\\p{{L}}\\p{{N}}.:{also}]", "")


def normal_labels(words: Column) -> Column:
    """normal_label of each word of a list."""
    return _each(words, normal_label, "\n", lambda s: normal_label(s, "\\n"), "\n")


def name_to_key(name: Column) -> Column:
    """Lower case with underscores, 30 characters at most; ``campo`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(unmarked(F.lower(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("campo")).otherwise(F.left(s, F.lit(30)))


def label_to_name(label: Column) -> Column:
    """The first letter of each word in upper case, the others as they are, 80 characters at most."""
    words = F.filter(F.split(F.translate(label, "_", " "), "[ \\t\\n\\r]+"), lambda w: w != "")
    return F.left(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "), F.lit(80))


def guess_type(value: Column) -> Column:
    """The kind of a value by its shape, ``text`` if it has none of them."""
    v = F.trim(value)
    out = F.when(v == "", F.lit("text"))
    for kind, shape in SHAPES:
        out = out.when(v.rlike(shape), F.lit(kind))
    return F.coalesce(out.otherwise(F.lit("text")), F.lit("text"))


def is_code(text: Column) -> Column:
    """Whether a token looks like the code of a table row and is no short word."""
    t = F.trim(text)
    return (F.char_length(t) <= 6) & t.rlike(CODE) & ~F.upper(t).isin(STOPWORDS)


def is_decoration(text: Column) -> Column:
    return text.rlike(DECORATION)


def is_prose(value: Column) -> Column:
    """Two or more words of at least three characters in lower case."""
    words = F.filter(F.split(value, "[ \\t\\n\\r]+"), lambda w: (F.char_length(w) >= 3) & F.substring(w, 1, 1).rlike("\\p{L}") & (w == F.lower(w)))
    return F.size(words) >= 2


def is_label(word: Column) -> Column:
    """Whether a normalised word is one of all labels."""
    return word.isin(list(KEYWORDS))


def label_kind(word: Column) -> Column:
    """The kind of field that a normalised label stands for, or null: a look-up in the set of all labels, then in that of each kind."""
    kinds: dict[str, list[str]] = {}
    for label, kind in KEYWORDS.items():
        kinds.setdefault(kind, []).append(label)
    return bound(word, lambda w: F.when(is_label(w), F.coalesce(*[F.when(w.isin(labels), F.lit(kind)) for kind, labels in kinds.items()])))
