"""What a cell of a sheet is, and the words of a line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostelry.functions.bound import bound
from hostelry.functions.dates import month_name_date, without_weekday
from hostelry.functions.text import MARKED, PLAIN

# Fixed values, which decide what a line of a file is: words of headers, totals, notes, page breaks and sections.
HEADER_WORDS = """
    data date giorno day nome cognome name dipendente persona persone reparto mansione ruolo qualifica
    area settore dipartimento department dept team squadra funzione posizione ore ora hours hour
    previste pianificate programmate effettive lavorate reali consuntivo planned scheduled actual worked
    costo costi cost importo totale total netto lordo imponibile iva vat tax valuta currency divisa
    prenotazione prenotazioni reservation booking codice id numero number arrivo partenza arrival
    departure checkin checkout check in out notti nights camere camera room rooms ospiti ospite
    guest guests pax canale channel provenienza source origine portale ota stato status tariffa rate
    ricavo revenue fornitore supplier vendor fattura invoice documento doc descrizione description
    categoria category scadenza due quantita quantity unita unit prezzo price commissione commission
    turno shift lun mar mer gio ven sab dom mon tue wed thu fri sat sun
""".split()
TOTAL_WORDS = ("tot", "totale", "totali", "subtotale", "sub totale", "totale generale", "totale complessivo", "total", "subtotal", "grand total", "somma", "sum")
NOTE_WORDS = (
    "nota", "note", "n b", "nb", "legenda", "fonte", "source", "generato", "stampato", "pagina", "page", "firma", "documento generato", "attenzione",
)
PAGE_WORDS = ("pagina", "pag", "page", "successiva", "segue", "continua", "continued", "riporto", "prosegue")
SECTION_WORDS = """
    reception housekeeping piani cucina ristorante sala bar manutenzione spa wellness direzione
    amministrazione ricevimento lavanderia colazioni colazione front office kitchen maintenance
    management food beverage reparto area settore team
""".split()
SECTION_FILLERS = ("e", "ed", "di", "del", "della", "dei", "delle", "and", "da", "per")
STOP_WORDS = """
    o e ed di del dello della dei degli delle dell da per la il lo le i gli un una the of and or a all alla nel nella
""".split()
NUMBER_WORDS = ("n", "nr", "nro", "num", "numero", "no", "number", "nbr")
SUM_WORDS = ("tot", "totale", "totali", "total", "totals", "totalizzato")

NUMBER = r"(?i)^[-+]?\s*(€|\$|£|eur\b)?\s*\d[\d.,' ]*\s*(€|%|eur\b)?$"
DATE = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-](\d{4}|\d{2}))([T ]\d{1,2}:\d{2}(:\d{2})?)?$"
TIME = r"^\d{1,2}:\d{2}(:\d{2})?$"
HOURS = r"(?i)^\s*([-+]?\d+([.,]\d+)?)\s*(h|hr|hrs|hour|hours|ora|ore)\.?\s*$"


def folded(text: Column) -> Column:
    """Lower case without marks, every other sign a single space (Latin-1; other letters count as signs)."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def stem(word: Column) -> Column:
    """A word without its ending; the ways to write number and total are one word each."""
    bare = F.regexp_replace(word, "(?<=^.{4,99})[aeio]$", "")
    return F.when(word.isin(*NUMBER_WORDS), "numer").when(word.isin(*SUM_WORDS), "total").otherwise(bare)


def stemmed(words: list[str]) -> list[str]:
    """Stems of fixed words, by the rule of ``stem``."""
    cut = lambda w: w[:-1] if len(w) >= 5 and w[-1] in "aeio" else w
    return sorted({"numer" if w in NUMBER_WORDS else "total" if w in SUM_WORDS else cut(w) for w in words})


def tokens(text: Column) -> Column:
    """Stems of the words that mean something; ``#`` is a number and a ``%`` that follows no digit a percentage.

    Abbreviations that a mark cuts in two ("Q.tà", "U.O.") are one word.
    """
    joined = F.regexp_replace(F.regexp_replace(folded(text), r"\bq ta\b", "qta"), r"\bu o\b", "uo")
    kept = F.filter(F.split(joined, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    signs = F.array_compact(F.array(F.when(text.rlike(r"(^|\D)#"), F.lit("numer")), F.when(text.rlike(r"(^|\D)%"), F.lit("perc"))))
    stems = F.transform(kept, stem)
    return F.concat(stems, F.array_except(signs, stems))


def is_empty(text: Column) -> Column:
    """Whether the kind of a cell is EMPTY."""
    return F.coalesce(F.trim(text), F.lit("")) == ""


def kind(text: Column) -> Column:
    """EMPTY, DATE, TIME, NUMBER or TEXT."""
    bare = F.trim(text)

    def rare(bare: Column) -> Column:
        is_date = bound(without_weekday(bare), lambda d: d.rlike(DATE) | month_name_date(d).isNotNull())
        return F.when(is_date, "DATE").when(bare.rlike(TIME), "TIME").when(bare.rlike(HOURS), "NUMBER").otherwise("TEXT")

    # What has no digit is a text; plain dates and numbers need not be looked at for weekdays and names of months.
    plain = F.when(is_empty(text), "EMPTY").when(~bare.rlike("[0-9]"), "TEXT").when(bare.rlike(DATE), "DATE").when(bare.rlike(NUMBER), "NUMBER")
    # A code ("B123"): all other kinds begin with a digit or sign, or have a space, point or hyphen behind a word.
    plain = plain.when(~bare.rlike(r"^[-+0-9]|[\s.\-]"), "TEXT")
    return plain.otherwise(bound(bare, rare))


def amount(text: Column) -> Column:
    """A written amount or number of hours as a decimal; null where it is none. With both marks the comma is the decimal one."""

    def read(bare: Column) -> Column:
        both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
        pointed = F.when(both, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
        return F.replace(pointed, F.lit(","), F.lit(".")).try_cast("decimal(20,4)")

    bare = F.regexp_replace(F.regexp_replace(F.trim(text), HOURS, "$1"), r"(?i)€|\beur(o)?\b\.?|\s", "")
    is_plain = text.rlike(r"^[0-9]+([.,][0-9]+)?$")
    return F.when(is_plain, F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(20,4)")).otherwise(bound(bare, read))


def starts_with(key: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a folded line is one of the phrases or begins with one and a space."""
    return key.rlike(f"^({'|'.join(phrases)})( |$)")


def is_total(key: Column) -> Column:
    return starts_with(key, TOTAL_WORDS)


def is_note(key: Column) -> Column:
    return starts_with(key, NOTE_WORDS)


def is_page_break(text: Column, key: Column) -> Column:
    """Words of a page break only, numbers and "of" among them, or a line of signs."""
    words = F.split(key, " ")
    only = F.forall(words, lambda w: w.isin(*PAGE_WORDS, "di", "of") | w.rlike("^[0-9]+$")) & F.exists(words, lambda w: w.isin(*PAGE_WORDS))
    return F.when(key == "", (F.trim(text) != "") & ~text.rlike(r"[\p{L}\p{N}]")).otherwise(only)


def is_section(text: Column, key: Column, wide: Column) -> Column:
    """A short line that names the rows below it: capitals, or words of departments, or a cell merged over the table."""
    words = F.filter(F.split(key, " "), lambda w: ~w.isin(*SECTION_FILLERS) & (w != ""))
    capitals = (F.upper(text) == text) & (F.length(F.regexp_replace(text, r"\P{L}", "")) >= 3)
    named = (F.size(words) > 0) & F.forall(words, lambda w: stem(w).isin(*stemmed(SECTION_WORDS)))
    return (F.length(text) <= 50) & ~is_note(key) & (wide | capitals | named)
