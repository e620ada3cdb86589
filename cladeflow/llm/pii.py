"""Personal details in free text: located, typed and replaced by placeholders.

Regular expressions propose spans, validators (Luhn, mod 97, number plans,
top-level domains) confirm or weaken them, and words close by adjust the score
of every kind. Names are found by their shape and what stands around them, not
by lists of names.
Escaped line breaks and quotes of notebooks kept as JSON are blanked in place
first, so that every offset counts code points of the text as it came.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 3
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in ("email", "phone", "id_number", "address", "person_name")}

# Domains that end an address, street words, label words, and ordinary words that begin with a capital.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name io ai dev app co me tv eu uk de fr es it nl be ch at se no dk fi pl cz sk hu ro bg gr pt"
    " ie is lt lv ee si hr rs ua ru tr il in cn jp kr tw hk sg my th vn id ph au nz za ng ke gh eg ma br ar cl pe mx ca us"
    " example test invalid localhost museum science".split()
)
STREET_AFTER = r"(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Close|Way|Boulevard|Blvd|Court|Ct|Square|Sq|Terrace|Place|Pl|Crescent|Gardens|Grove|Row|Hill|Walk|Mews|Parkway|Pkwy|Highway|Hwy)"
STREET_BEFORE = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Cc]hemin|[Ii]mpasse|[Aa]ll[ée]e|[Qq]uai|[Pp]lace)"
STREET_FIRST = r"(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Rua|Travessa|Ulica|ul\.)"
GERMAN = r"(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur|Unter den|Alte|Neue) [A-ZÄÖÜ][\w-]+|[A-ZÄÖÜ][\w-]*(?:stra(?:ß|ss)e|str\.|allee|weg|gasse|platz|ring|damm|ufer|steig|hof|chaussee))"
NOT_A_NAME = frozenset(
    "the a an in out cell table figure random monte forest carlo last next first note notes lesson chapter section version traceback"
    " error warning info debug most recent call analysis report thanks questions samples collector written author read return each"
    " every after before while when where which who what how if else for and or not this that these those we our dear mr mrs ms dr"
    " prof new old north south east west lower upper street road avenue lane drive close way flat apt calle rue am markdown python"
    " import from class def true false none null monday tuesday wednesday thursday friday saturday sunday january february march april"
    " may june july august september october november december homo sapiens bold tel phone passport nino ssn ausweisnr national tax personal ni".split()
)

# Leading characters come before the checks of what precedes them, so that a search skips to candidates.
AT = re.compile(r"@|%40|[\[(][ ]?at[ ]?[\])]", re.IGNORECASE)
LOCAL = re.compile(r"\w[\w.+'-]{0,63}(?=[ ]?\Z)")
DOMAIN = re.compile(r"[ ]?[\w-]+(?:(?:\.|[ ]?[\[(][ ]?dot[ ]?[\])][ ]?)[\w-]+)+", re.IGNORECASE)
PHONE = re.compile(
    r"[+(\d](?<![\w.+/-].)(?<!\w[-(].)(?:"
    r"(?<=\+)\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d(?:[ .-]?\d){6,11}"
    r"|(?<=\+)\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d(?:[ .-]?\d){5,10}"
    r"|(?<=0)0\d{2}[ ]?(?:\(0\)[ ]?)?\d(?:[ .-]?\d){6,11}"
    r"|(?<=\()[2-9]\d{2}\)[ ]?[2-9]\d{2}[ .-]\d{4}"
    r"|(?<=[2-9])\d{2}[.-][2-9]\d{2}[.-]\d{4}"
    r"|(?<=0)\d(?:[. -]\d{2}){4}"
    r"|(?<=0)\d{3,4}[ ]\d{3}[ ]?\d{3}"
    r")(?![\w]|[.-]\d)"
)
# Shapes that count only with words, and for plain digits a checksum, close by on the line.
PHONE_WORD = re.compile(r"(?<![A-Za-z])(?:tel|telephone|telefon|tél|phone|mobile|cell|call|ring|fax|contact|reach)(?![A-Za-z])", re.IGNORECASE)
WEAK_PHONE = re.compile(r"(?<![\w.+/(-])(?:0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{3,4})?|[2-9]\d{2} [2-9]\d{2} \d{4})(?!\w|[./-]\d| \d)")
ID_WORD = re.compile(
    r"(?<![A-Za-z0-9])(?:SSN|ssn|[Ss]ocial [Ss]ecurity|[Tt]ax(?:payer)? (?:id|ID|no|number)|TIN|[Ss]teuer(?:-?ID|nummer|nr)|NINO|[Nn]ational (?:[Ii][Dd]|[Ii]nsurance|[Ii]dentity)"
    r"|[Pp]assport|PASSPORT|[Rr]eisepass|[Pp]asaporte|[Pp]asseport|[Aa]usweis|[Pp]ersonal (?:number|no)|[Pp]ersonnummer|[Ii]dentity (?:card|no|number)|DNI|NIF|NIE|PESEL|CPF)(?![A-Za-z0-9])"
)
WEAK_ID = re.compile(r"(?<![\w.+/-])(?:[A-Z]{1,2}\d{6,8}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d(?:[ ./-]?\d){8,14})(?!\w|[./-]\d)")
NEAR = 40
ESCAPED = re.compile(r"(?<!\\)\\u(?:[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(?![dD][89a-fA-F])[0-9a-fA-F]{4})")
LABELS = (
    "SSN", "ssn", "ecurity", "ax id", "ax ID", "ax no", "ax number", "payer ", "TIN", "teuer", "NINO", "NI n", "ational I", "ational i",
    "assport", "PASSPORT", "usweis", "eisepass", "asaporte", "asseport", "ersonal n", "ersonnummer", "dentity ", "DNI", "NIF", "NIE",
    "PESEL", "CPF",
)
LABELLED = re.compile(
    r"(?<![A-Za-z0-9+/])(?:"
    r"(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: (?:[Nn]o\.?|[Nn]umber))?|[Tt]ax(?:payer)? (?:id|ID|no\.?|number)|TIN|[Ss]teuer(?:-?ID|nummer|nr\.?)"
    r"|NINO|NI (?:number|no\.?)|[Nn]ational (?:[Ii][Dd]|[Ii]nsurance)(?: (?:no\.?|number))?|[Pp]assport(?: (?:[Nn]o\.?|[Nn]umber))?|PASSPORT(?: NO\.?)?"
    r"|[Aa]usweis(?:nr\.?|nummer)?|[Rr]eisepass(?:nr\.?)?|[Pp]asaporte|[Pp]asseport|[Pp]ersonal (?:number|no\.?)|[Pp]ersonnummer|[Ii]dentity (?:card )?(?:no\.?|number)|DNI|NIF|NIE|PESEL|CPF)"
    r")[ ]?[:=#]?[ ]{0,2}((?=[A-Z0-9/ .-]*\d)[A-Z]{0,3}\d?[A-Z0-9](?:[ ./-]?[A-Z0-9]){4,16})(?![\w])"
)
BARE_SSN = re.compile(r"-\d{2}-\d{4}(?![\w]|[-./]\d)")
SSN_HEAD = re.compile(r"(?<![\w./+-])(?!000|666)\d{3}\Z")
CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-Ž]"
STREET_WORD = r"(?:[A-Z][\w'’-]+)"
NUMBER_FIRST = re.compile(
    r"\d(?<![\w.#-].)\d{0,4}(?:"
    r"[a-z]?,? " + f"(?:{STREET_WORD}[ ]){{1,3}}{STREET_AFTER}" + r"\b"
    r"|(?: ?(?:bis|ter)|[a-z])?,? " + STREET_BEFORE + r"(?: (?:de la|de l'|du|des|de|d'|le|la|les))? ?[A-ZÀ-Þ][\w'’-]+"
    r")"
)
NUMBER_FIRST_HINTS = tuple(f" {w}" for w in re.findall(r"[A-Z]\w+", STREET_AFTER)) + (
    " rue ", " Rue ", " avenue ", " boulevard ", " chemin ", " Chemin ", " impasse ", " allée ", " allee ", " quai ", " place ",
)
FLAT = re.compile(r"(?<!\w)(?:Flat|Apt\.?|Apartment|Unit|Suite) \d{1,4}[A-Za-z]?,[ \n]{1,2}\Z")
STREET_FIRST_HINTS = (
    "Calle ", "Avenida ", "Avda", "Plaza ", "Paseo ", "Camino ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "Travessa ", "Ulica ", "ul. ",
)
GERMAN_HINTS = (
    "Am ", "An der ", "Im ", "In der ", "Auf der ", "Zum ", "Zur ", "Unter den ", "Alte ", "Neue ", "straße ", "strasse ", "str. ",
    "allee ", "weg ", "gasse ", "platz ", "ring ", "damm ", "ufer ", "steig ", "hof ", "chaussee ",
)
STREET_NAMED = re.compile(
    r"(?<![\w.#-])" + STREET_FIRST + r"(?: (?:de la|de los|de las|del|de|della|dei|do|da))? [A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?,? \d{1,4}[a-z]?(?![\w])"
)
GERMAN_NAMED = re.compile(r"(?<![\w.#-])" + GERMAN + r" \d{1,4}[a-z]?(?![\w.])")
MARK = r"\u0300-\u036f"
LETTERS = rf"(?:[\w{MARK}]|['’](?=\w))*"
REST = rf"{LETTERS}(?:-{CAPITAL}{LETTERS})?"
PART = rf"{CAPITAL}{REST}"
GAP = r"[ \xa0]{1,2}"
NAME = re.compile(
    rf"{CAPITAL}(?<![\w.@/{MARK}-].)(?:\.{GAP}(?:{CAPITAL}\.{GAP})?{PART}"
    rf"|{REST},[ \xa0](?:{CAPITAL}\.(?:[ \xa0]{CAPITAL}\.)?(?!\w)|{PART}(?:[ \xa0]{CAPITAL}\.(?!\w))?)"
    rf"|{REST}{GAP}(?:{CAPITAL}\.{GAP})?{PART})(?![\w@/=(\[{MARK}])"
)
CUE_BEFORE = re.compile(
    r"(?:(?:reviewed|written|prepared|collected|identified|signed|sent|maintained|created|edited|checked|made) by|\b(?:go|back|over) to|\bthanks to|\bask|\bcontact"
    r"|\bcollector|\bresponsable|\bansprechpartner(?:in)?|\bauthors?|\bsigned|\bdr\.?|\bprof\.?|\bmrs?\.?|\bms\.?|\bowner|\bcurator|\bname['\"]?|user\(?"
    r"|\bregards|\bsincerely|\bdear|\bspoke (?:to|with)|\bmet)[\s:=,]{0,3}['\"]?\s?$",
    re.IGNORECASE,
)
CUE_AFTER = re.compile(r"[ ,;(<|]{0,3}(?:tel\b|call\b|phone\b|mailto|<|\(tel)", re.IGNORECASE)
# Running text: a name follows a small word that isn't an article or a preposition, and someone acts.
PROSE_BEFORE = re.compile(r"(?<![\w.])(?!(?:the|a|an|this|each|every|our|your|its|all|in|at|on|of|from|near|into|with|per|by|via)\b)[a-z]{2,} $")
ACTS = re.compile(r" (?:was|is|has|had|will|wrote|said|[a-z]{3,}ed)\b(?! (?:fitted|trained|run|used|computed)\b)")
ROW_BEFORE = re.compile(r"(?:^|\n|\\n)\s*(?:row )?\d+[ :;|,\t]*$")
# Words that speak for a kind of detail within NEAR characters on the line, or against any right before it.
FOR = {
    "email": re.compile(r"(?i)(?<![a-z])(?:e-?mail|mail|mailto|contact|write|user|author)(?![a-z])"),
    "phone": PHONE_WORD,
    "address": re.compile(r"(?i)(?<![a-z])(?:address|adresse|lives?|stored|ship|post|flat|visit|direcci[oó]n)(?![a-z])"),
}
AGAINST = re.compile(r"(?i)(?<![a-z])(?:version|serial|seed|accession|isbn|issn|doi|checksum|sha\d*|md5|build|commit|ticket)(?: (?:no\.?|number|id))?['\"]?[ ]?[:=#]?[ ]?['\"]?$")
CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return len(digits) > 1 and total % 10 == 0


def mod97(digits: str) -> bool:
    """The last two digits are 97 less the rest's remainder, or the whole leaves 1."""
    return len(digits) > 4 and (int(digits) % 97 == 1 or int(digits[-2:]) == 97 - int(digits[:-2]) % 97)


def _weighted(digits: str, weights: range | tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights))


def pesel(digits: str) -> bool:
    return len(digits) == 11 and _weighted(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)) % 10 == 0


def cpf(digits: str) -> bool:
    return len(digits) == 11 and all(_weighted(digits, range(n + 1, 1, -1)[:n]) * 10 % 11 % 10 == int(digits[n]) for n in (9, 10))


def steuer_id(digits: str) -> bool:
    """ISO 7064 mod 11, 10."""
    product = 10
    for d in digits[:-1]:
        product = ((product + int(d)) % 10 or 10) * 2 % 11
    return len(digits) == 11 and (11 - product) % 10 == int(digits[-1])


def dni(cell: str) -> bool:
    """Spanish DNI or NIE: the letter follows from the number."""
    bare = re.sub(r"[ ./-]", "", cell)
    return bool(re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", bare)) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == bare[-1]


def checked(cell: str) -> bool:
    """Whether a number's check digits are right in a scheme of its length."""
    digits = "".join(c for c in cell if c.isdigit())
    if any(c.isalpha() for c in cell):
        return dni(cell)
    n = len(digits)
    return n in (9, 10) and luhn(digits) or n in (11, 15) and mod97(digits) or pesel(digits) or cpf(digits) or steuer_id(digits)


SCHEMES = {"PESEL": pesel, "CPF": cpf}


def _plain(word: str) -> str:
    bare = unicodedata.normalize("NFD", word.replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O"))
    return "".join(c for c in bare if not unicodedata.combining(c)).lower()


def unescaped(text: str) -> str:
    """The text with escaped breaks, tabs and quotes as such, every character in its place."""
    if "\\" in text:
        for escape, plain in (("\\n", " \n"), ("\\r", " \r"), ("\\t", " \t"), ('\\"', ' "')):
            text = text.replace(escape, plain)
    return text


def decoded(text: str) -> tuple[str, np.ndarray | None]:
    """The text with \\uXXXX escapes as the characters they stand for, and where each character (and the end) was before."""
    if "\\u" not in text or not ESCAPED.search(text):
        return text, None
    out, steps, at = [], [], 0
    for m in ESCAPED.finditer(text):
        out += [text[at : m.start()], m.group(0).encode().decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16")]
        steps += [np.arange(at, m.start() + 1)]
        at = m.end()
    return "".join(out) + text[at:], np.concatenate([*steps, np.arange(at, len(text) + 1)])


def _mails(text: str) -> Iterator[tuple[int, int, int]]:
    for m in AT.finditer(text):
        first = max(0, m.start() - 66)
        local = LOCAL.search(text[first : m.start()])
        domain = DOMAIN.match(text, m.end())
        if not local or not domain or (m.group(0) in ("@", "%40") and (local.end() != m.start() - first or domain.group(0)[0] == " ")):
            continue
        end = domain.end() - (len(domain.group(0)) - len(domain.group(0).rstrip("-_")))
        if re.split(r"[.\])\[( ]+", text[m.end() : end])[-1].lower() in TOP_LEVEL:
            yield first + local.start(), end, 3


def _ids(text: str) -> Iterator[tuple[int, int, int]]:
    if any(label in text for label in LABELS):
        for m in LABELLED.finditer(text):
            digits = "".join(c for c in m.group(1) if c.isdigit())
            if len(digits) >= 5:
                scheme = next((f for label, f in SCHEMES.items() if m.group(0).startswith(label)), None)
                yield m.start(1), m.end(1), 3 if scheme is None else 4 if scheme(digits) else 2
    for m in BARE_SSN.finditer(text):
        if m.start() >= 3 and SSN_HEAD.search(text, max(0, m.start() - 4), m.start()):
            yield m.start() - 3, m.end(), 3


def _near(text: str, word: re.Pattern, shape: re.Pattern) -> Iterator[tuple[re.Match, str]]:
    """Shapes at most NEAR characters before or behind a word on the same line, with that word."""
    for w in word.finditer(text):
        first = max(text.rfind("\n", 0, w.start()) + 1, w.start() - NEAR - 24)
        last = text.find("\n", w.end())
        last = min(last if last >= 0 else len(text), w.end() + NEAR + 24)
        for m in shape.finditer(text, first, len(text)):
            if m.start() > last:
                break
            if m.end() <= last and -NEAR <= m.start() - w.end() <= NEAR or 0 <= w.start() - m.end() <= NEAR:
                yield m, w.group(0)


def _weak_ids(text: str) -> Iterator[tuple[int, int, int]]:
    """Unlabelled shapes score 0, a word close by 2, right check digits or a passport's letters by its word 1."""
    if any(label in text for label in LABELS):
        for m, word in _near(text, ID_WORD, WEAK_ID):
            cell = m.group(0)
            lettered = re.fullmatch(r"[A-Z]{1,2}\d{6,8}", cell) and re.search(r"ass?(?:e?port|aporte)|ASSPORT|eisepass|usweis", word)
            yield m.start(), m.end(), 2 + bool(lettered or checked(cell))


def _weak_phones(text: str) -> Iterator[tuple[int, int, int]]:
    """Shapes without country code or bracket score 2, a word close by 1."""
    for m, _ in _near(text, PHONE_WORD, WEAK_PHONE):
        if 9 <= sum(c.isdigit() for c in m.group(0)) <= 12:
            yield m.start(), m.end(), 3


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    if any(hint in text for hint in NUMBER_FIRST_HINTS):
        for m in NUMBER_FIRST.finditer(text):
            flat = FLAT.search(text, max(0, m.start() - 24), m.start())
            yield flat.start() if flat else m.start(), m.end(), 3
    for hints, pattern in ((STREET_FIRST_HINTS, STREET_NAMED), (GERMAN_HINTS, GERMAN_NAMED)):
        if any(hint in text for hint in hints):
            for m in pattern.finditer(text):
                yield m.start(), m.end(), 3


def _phones(text: str) -> Iterator[tuple[int, int, int]]:
    for m in PHONE.finditer(text):
        n = sum(c.isdigit() for c in m.group(0))
        if 9 <= n <= 15:
            yield m.start(), m.end(), 3


def _names(text: str, others: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``others``: sorted starts and ends of spans found before, of which one close behind on the line speaks for a name."""
    last_end = -99
    at = 0
    while m := NAME.search(text, at):
        start, end = m.span()
        at = end
        parts = [p for p in re.split(r"[\s,]+", m.group(0)) if p]
        plain = [_plain(p.rstrip(".")) for p in parts]
        if any(p in NOT_A_NAME for p, part in zip(plain, parts) if not part.endswith(".")):
            # What follows the ordinary word may be a name itself.
            at = start + len(parts[0])
            continue
        score = 1 if any(len(p) > 1 for p in plain) else 0
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        if CUE_BEFORE.search(before):
            score += 2
        elif PROSE_BEFORE.search(before) and ACTS.match(after):
            score += 2
        if CUE_AFTER.match(after):
            score += 1
        if start - last_end <= 5 and text[last_end:start].strip() in ("and", "&", ",", "y", "et", "und"):
            score += 2
        i = np.searchsorted(others, end)
        if i < len(others) and others[i] - end <= 24 and "\n" not in text[end : others[i]]:
            score += 2
        if before.rstrip(" ")[-1:] in ("|", ";") and after.lstrip(" ")[:1] in ("|", ";"):
            score += 1
        if score >= THRESHOLD:
            last_end = end
        yield start, end, score


def _by_context(text: str, kind: str, start: int, end: int, score: int) -> int:
    """The score, one more with a word for the kind close by on the line, two less with a word against any right before."""
    first = max(text.rfind("\n", 0, start) + 1, start - NEAR)
    last = text.find("\n", end)
    last = min(last if last >= 0 else len(text), end + NEAR)
    around = text[first:start] + " " + text[end:last]
    # A number's label has been counted already.
    return score + bool(kind in FOR and FOR[kind].search(around)) - 2 * bool(AGAINST.search(text, first, start))


def find_details(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of every detail, in order and without overlaps; none in a null or empty text."""
    if not text:
        return []
    work, origin = decoded(text)
    work = unescaped(work)
    found: list[tuple[int, int, int, str]] = []
    sources = (("email", _mails(work)), ("id_number", _ids(work)), ("phone", _phones(work)), ("address", _addresses(work)))
    for kind, source in sources:
        found += [(s, e, _by_context(work, kind, s, e, score), kind) for s, e, score in source]
    starts = np.array(sorted(x[0] for x in found), np.int64)
    found += [(s, e, score, "person_name") for s, e, score in _names(work, starts)]
    weak = [(s, e, score, kind) for kind, source in (("phone", _weak_phones(work)), ("id_number", _weak_ids(work))) for s, e, score in source]
    kept: list[tuple[int, int, int, str]] = []
    rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "person_name": 4}
    # Of overlapping spans the kind named first counts, then the longer one.
    taken: list[tuple[int, int]] = []
    for s, e, score, kind in sorted(found, key=lambda x: (rank[x[3]], x[0] - x[1], x[0])) + weak:
        if score >= THRESHOLD and not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            kept.append((s, e, score, kind))
    if origin is not None:
        kept = [(int(origin[s]), int(origin[e]), score, kind) for s, e, score, kind in kept]
    return [(kind, s, e) for s, e, _, kind in sorted(kept)]


def redact(text: str | None) -> str | None:
    """The text with typed placeholders; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in find_details(text):
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]


def details(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, start_at, end_at) of every detail; repeated documents are read each, other columns ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, d) for i, x in enumerate(batch.column(1).to_pylist()) for d in find_details(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                    pa.array([d[0] for _, d in rows], pa.string()),
                    pa.array([d[1] for _, d in rows], pa.int64()),
                    pa.array([d[2] for _, d in rows], pa.int64()),
                ],
                names=[key, "pii_type", "start_at", "end_at"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, pii_type string, start_at bigint, end_at bigint")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with placeholders in place of details."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redact(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), clean], names=[key, text])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
