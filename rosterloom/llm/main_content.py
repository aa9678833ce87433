"""Main body of web pages: template deduction by equivalence classes of tokens, and residue of templates and errors.

The lines of a page are its tokens; a line that joins labels (a menu in one row) is cut into them. Tokens of one host
that occur on exactly the same set of addresses (equal occurrence vectors) form an equivalence class, a candidate if two
or more addresses carry it, and at least ``MIN_SUPPORT`` of all addresses of the host. A class of ``MIN_SIZE`` or more
tokens is ordered if its tokens stand in one order wherever a record has them all. On each record a candidate is nested
in the enclosing class, that of the next greater support which the record has whole: the tokens of an ordered class are
slots' borders, and a class is valid if each of its tokens falls into one and the same slot of every ordered class it is
nested in. An outermost class has nothing to be nested in and must be ordered; a class of one token, or one without
order, is taken token by token and must be nested. Valid classes are the host's template, and what is not in it fills
the template's slots. Tokens that stand before an e-mail address on most of their pages belong to contact blocks, which
are content however often they are repeated. Tokens that several hosts repeat are the vocabulary of page furniture;
together with a few fixed lines it serves hosts of too few pages. A side box is its heading and a slot; how many lines
the slot has is learned from the boxes of all hosts whose lines are known tokens.

A record is residue if what is left without furniture is an error page, a notice in place of the page, filler, or has
unfilled placeholders where values belong. Messages are judged before recurrent lines are subtracted, since one server
error may stand on many pages. Filler is known by its first words, and by the words that filler lines of several hosts
use: a line made of such words only is filler without those first words too.

Each text is parsed once: a record becomes a row of short lists (line numbers, kinds, token hashes), and all later steps
work on those rows. The template of a host is bounded, whatever the size of the host: a candidate stands on a share
``MIN_SUPPORT`` of its addresses, so there are at most 1 / ``MIN_SUPPORT`` times as many as an address has tokens.

Defined results: NULL and '' have no body and are no residue; of repeated fetches of an address in one source the last
stands for all where support is counted; lines are numbered from 1 with blank lines counted; empty tables give no rows;
texts of any length are processed whole; extra columns are ignored. No host, however large, is gathered in one task:
support is counted with map-side combining, and the records of hot hosts are spread when they meet their template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.operators.skew import lookup_join
from rosterloom.session import cut_lineage

#: Tokens of a class that can enclose others.
MIN_SIZE = 2
#: Share of a host's addresses, and number of them, that must carry a class; hosts on which a token must be valid to be furniture anywhere, share of a line's tokens.
MIN_SUPPORT, MIN_PAGES, MIN_HOSTS, MIN_SHARE = 0.05, 2, 3, 0.6
#: Share of a token's pages on which it may stand before an address, share of the hosts that must agree on furniture.
MAX_CONTACT, MOST = 0.5, 0.7
#: Share of a line that an address takes up on a line of contact.
CONTACT_SHARE = 0.2
#: Words of a line, share of them that must be words of filler, and share of the hosts with filler that must use a word.
FILLER_WORDS, FILLER_MATCH, FILLER_SHARE = 8, 0.9, 0.01
#: Tokens of the furniture vocabulary up to which it goes to every task (8 bytes each); a larger one is joined.
VOCABULARY = 2_000_000

_CUT = re.compile(r"\s+[|/·•›»>]\s+|\s{3,}|\s*›\s*")
_LIST = re.compile(r"(?:[•▪*–-]|\d{1,3}[.)])\s+\S")
_MAIL = re.compile(r"[\w.+-]+\s*(?:@|\[at\]|\(at\)|\[@\]| at )\s*[\w-]+\s*(?:\.|\[dot\]|\(dot\)| dot )\s*\w+", re.I)
_PHONE = re.compile(r"(?:(?:tel|phone|tél|fon)\.?:?\s*)?\+\d[\d ()./-]{5,}", re.I)

# Whole lines of page furniture in the five languages of the data, for hosts of too few pages; lower case.
_LINES = frozenset((
    "skip to content", "skip to main content", "jump to content", "jump to navigation", "aller au contenu", "aller au menu", "saltar al contenido", "zum inhalt", "zum inhalt springen", "vai al contenuto",
    "search", "search this site", "suche", "suchen", "buscar", "buscar en el sitio", "recherche", "rechercher", "recherche sur le site", "rechercher sur le site", "cerca", "cerca nel sito",
    "back to top", "top", "haut de page", "volver arriba", "nach oben", "torna su",
    "share this page", "partager cette page", "compartir esta página", "seite teilen", "condividi la pagina", "print | e-mail | copy link",
    "subscribe to our newsletter", "newsletter abonnieren", "recevez notre lettre d’information", "recevez notre lettre d'information", "suscríbete al boletín", "iscriviti alla newsletter",
))
_STARTS = ("you are here:", "you are here :", "vous êtes ici:", "vous êtes ici :", "estás en:", "sie sind hier:", "ti trovi in:", "stay in touch:")
_CHANGED = re.compile(r"(?:page last changed on|last updated?:?|page mise à jour le|última actualización:|zuletzt geändert am|ultimo aggiornamento:)\s+[\w. ]+\d{4}")
_RIGHTS = re.compile(r"©.*\d{4}")
_SWITCH = re.compile(r"(?:[a-z]{2}[ |/·-]+){1,6}[a-z]{2}")
_SHORT_PHONE = re.compile(r"t\.\s\d{2,4}[\d ]+")
_BETWEEN = re.compile(r"\s*[|•·/–-]\s*")
_LEGAL = frozenset((
    "legal notice", "sitemap", "privacy", "accessibility", "freedom of information", "impressum", "datenschutz", "barrierefreiheit", "mentions légales", "données personnelles", "plan du site", "accessibilité",
    "aviso legal", "privacidad", "mapa web", "accesibilidad", "note legali", "mappa del sito", "accessibilità",
))
_COOKIE_LINES = frozenset(("necessary only", "allow everything", "accept all", "reject all", "gérer mes préférences de confidentialité"))
_COOKIE_STARTS = (
    "this website stores small files", "we use cookies", "by continuing to browse", "your privacy matters to us", "si continúa navegando", "usamos cookies", "mit der nutzung dieser seite", "wir verwenden cookies",
    "en poursuivant votre navigation", "ce site dépose des cookies", "questo sito usa cookie", "proseguendo la navigazione",
)
_BOX_LINES = frozenset((
    "related pages", "quick links", "in this section", "you may also like", "latest news", "liens utiles", "dernières actualités", "à lire aussi", "enlaces rápidos", "últimas noticias", "también te puede interesar",
    "das könnte sie interessieren", "neueste meldungen", "schnellzugriff", "ultime notizie", "potrebbe interessarti", "link utili",
))
_ADDRESS = re.compile(r"[^,]{4,80},\s[^,\d]{2,40}\s\d{1,4},\s\d{4,5}\s[^,\d]{2,40}(?:\s–\st\.\s[\d ]+)?")

# Messages that stand in place of a page, whole lines; and forms of unfilled placeholders.
_MESSAGE = re.compile(
    r"""^(?:
    (?:(?:http\ )?(?:error|erreur|fehler|errore)\s*:?\s*\#?)?[45]\d\d\s*(?:[–—:-]|not\ found|forbidden|internal|bad\ |service|unauthori[sz]ed|gone|too\ many|gateway).{0,90} | (?:error|erreur|fehler|errore)\s*:?\s*\#?[45]\d\d\b.{0,90}
    | .{0,60}\((?:error|erreur|fehler|errore)\s*[45]\d\d\)\.? | (?:sorry,\ )?(?:the|this|that|la|le|die|diese|questa)?\ ?(?:requested\ )?(?:page|página|pagina|seite)\b.{0,50}(?:not\ (?:be\ )?found|no\ longer\ exists|does\ not\ exist|introuvable|nicht\ gefunden|no\ existe|non\ trovata|no\ encontrada|non\ esiste|n.existe\ (?:pas|plus)).{0,80}
    | (?:access|permission)\ denied[.!]? | forbidden[.!]? | acceso\ denegado[.!]? | zugriff\ verweigert[.!]? | accès\ refusé[.!]? | accesso\ negato[.!]? | .*don.t\ have\ permission.*
    | .{0,40}internal\ (?:server\ )?error.{0,60} | error\ establishing\ a\ connection.* | too\ many\ requests.* | bad\ gateway.{0,20} | gateway\ time-?out.{0,20} | request\ (?:timed\ out|timeout).{0,40}
    | .{0,60}(?:temporarily|currently)\ unavailable.{0,80} | (?:(?:the|this|our|le|il|el|der|die)\ )?(?:site|sito|sitio|website|web|page|portal|service|server|system)\b.{0,30}\b(?:under|down\ for|in|en)\ (?:maintenance|mantenimiento|manutenzione)\b.{0,60} | (?:estamos|we\ are|nous\ sommes|siamo)\ (?:under|in|en)\ (?:maintenance|mantenimiento|manutenzione)\b.{0,60} | wartungsarbeiten.{0,60} | (?:(?:this|the|our)\ )?(?:site|page|website)\b.{0,12}under\ construction.{0,30} | under\ construction[.!…]* | coming\ soon.{0,20}
    | session\ expired.* | (?:your\ )?session\ has\ (?:expired|ended).* | sesión\ caducada.* | sitzung\ abgelaufen.* | session\ expirée.* | sessione\ scaduta.*
    | .{0,60}(?:enable|activer|activez|activar|active|aktivieren|abilitare|attivare|turn\ on|requires?|nécessite|requiere|benötigt)\b.{0,25}\b(?:javascript|scripts?)\b.{0,70} | .{0,40}\b(?:javascript|scripts?)\b.{0,40}(?:required|disabled|enabled|turned\ off|détecté|aktivier\w*|necesario).{0,60}
    | no\ script\ support.* | (?:please\ )?wait\ while.{0,60} | loading\s*(?:…|\.\.\.)? | chargement.{0,12} | cargando.{0,6} | wird\ geladen.{0,6} | caricamento.{0,12} | checking\ your\ browser.*
    | it\ works!.* | sample\ page | this\ is\ an\ example\ page.* | hello\ world!? | just\ another\ \w+\ site
    | your\ text\ goes\ here.* | .*replace\ this\ paragraph.* | blindtext\b.* | texto\ de\ ejemplo\b.* | ins[ée]rez\ ici\b.* | inserire\ qui\b.* | hier\ steht\ später.* | testo\ di\ (?:prova|esempio).* | (?:dummy|placeholder|sample)\ text.*
    | (?:incident|reference|request|error|ray|ticket|code|ref|référence|vorgang|incidente)(?:\ id|\ no\.?|\ number|\ code)?\s*[:#]\s*[\w-]+ | (?:nginx|apache)[/\w. ()-]{0,40}
    )$""",
    re.I | re.X,
)
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,40}\}\}|\{%[^{}%\n]{1,40}%\}|\$\{[^{}\n]{1,40}\}|\{\d{1,2}\}|%[A-Z][A-Z_]{2,30}%|\[(?:INSERT|YOUR|ENTER|ADD)\b[^\]\n]{0,40}\]|<[a-z]+(?:_[a-z]+)+>|«[A-ZÀ-Ý]\w{2,20}»|\b__[A-Z][A-Z_]{2,30}__\b|__[A-Z][A-Z_]{2,30}__|##[A-Z][A-Z_]{1,30}##"
    r"|\[\[\w{2,30}\]\]|\bXXX-[A-Z]+-XXX\b|\[object Object\]|(?:^|:\s*|\bTel\.\s*)(?:undefined|TODO\b.*|NaN|null)\s*$"
)
_FILLER_START = re.compile(r"\blorem\s+ipsum\b|\bdolor\s+sit\s+amet\b", re.I)
_SENTENCE_MARKS = frozenset(".!?")

#: Every message holds one of these words; lines without one needn't be matched.
_MESSAGE_WORDS = frozenset(
    "400 401 403 404 410 429 500 502 503 504 error erreur fehler errore found exists exist introuvable gefunden existe existiert trovata encontrada esiste denied denegado verweigert refusé negato forbidden permission internal"
    " establishing requests gateway timed timeout unavailable maintenance mantenimiento manutenzione wartungsarbeiten construction soon expired ended caducada abgelaufen expirée scaduta javascript script scripts wait loading"
    " chargement cargando geladen caricamento checking works sample example hello another text paragraph blindtext ejemplo ici qui später testo dummy placeholder incident reference request ray ticket code ref référence vorgang"
    " incidente nginx apache".split()
)
_WORD = re.compile(r"\w+")
_HOLE_SIGN = re.compile(r"[{$%\[<«#]|__|XXX|undefined|TODO|NaN|null")

#: First words of the fixed lines above.
_FIRST_WORDS = frozenset(x.split()[0].rstrip(":") for x in (*_LINES, *_STARTS, *_LEGAL, "page", "last", "última", "zuletzt", "ultimo")) | frozenset(p for x in _LEGAL for p in _BETWEEN.split(x))

#: Kinds of lines. Of two holes in a line, or one that fills it, the line itself is a placeholder.
OTHER, LIST, COOKIE, BOX, FURNITURE, MESSAGE, FILLER, HOLE, HOLES = range(9)
#: Added to the kind of a line that holds an address.
WITH_MAIL = 16

LINES = T.StructType([T.StructField("src", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("url", T.LongType()), T.StructField("host", T.LongType())] + [
    T.StructField(n, T.ArrayType(t)) for n, t in (("no", T.IntegerType()), ("kind", T.IntegerType()), ("prose", T.IntegerType()), ("ntok", T.IntegerType()), ("key", T.LongType()), ("keys", T.LongType()), ("contact", T.LongType()))
])
#: The candidates of a record, as lists.
MARK = ("place", "hk", "class_id", "size", "support")
NESTED = T.StructType([T.StructField(n, t) for n, t in (("hk", T.LongType()), ("owner", T.LongType()), ("lo", T.IntegerType()), ("hi", T.IntegerType()), ("own", T.BooleanType()), ("n", T.LongType()))])
#: Owner of the rows of ``NESTED`` that count the lines after the headings of boxes (hk) in place of classes.
BOXES = -1
JUDGED = T.StructType([T.StructField("src", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("body", T.ArrayType(T.IntegerType())), T.StructField("residue", T.StringType())])


def normal(line: str) -> str:
    return " ".join(line.split()).casefold()


def parts(bare: str, low: str) -> list[str]:
    """The labels that a line joins, or the line itself; ``low`` is its normal form."""
    if ". " in bare or not ("   " in bare or "\t" in bare or any(c in bare for c in "|/·•›»>")):
        return [low]
    found = [normal(p) for p in _CUT.split(bare) if p and p.strip()]
    return found if len(found) > 1 and max(map(len, found)) <= 60 else [low]


def hole(line: str) -> bool:
    """Whether a line has an unfilled placeholder."""
    return bool(_HOLE_SIGN.search(line)) and bool(PLACEHOLDER.search(line))


def furniture(low: str) -> bool:
    """Whether a line, in lower case and with single blanks, is furniture by its own words."""
    bare = low.removeprefix("↑").lstrip()
    first = bare[:1]
    if first == "©":
        return bool(_RIGHTS.match(bare))
    if bare[2:3] and bare[2:3] in " |/·-" and _SWITCH.fullmatch(bare):
        return True
    if bare.count(",") == 2 and _ADDRESS.fullmatch(bare):
        return True
    if bare.partition(" ")[0].rstrip("….:") not in _FIRST_WORDS:  # all that follow begin with one of these words
        return first == "t" and bool(_SHORT_PHONE.fullmatch(bare))
    if bare in _LINES or (bare[-1:] in "….:" and bare.rstrip("….:") in _LINES) or bare.startswith(_STARTS):
        return True
    return (bare[-1:].isdigit() and bool(_CHANGED.fullmatch(bare))) or all(p in _LEGAL for p in _BETWEEN.split(bare))


def lexical(bare: str, low: str, filler_words: frozenset[str] = frozenset()) -> int:
    """What a line is by its own words; ``low`` is its normal form."""
    if hole(bare):
        return HOLES if len(PLACEHOLDER.findall(bare)) > 1 or len(PLACEHOLDER.sub("", bare)) <= 25 else HOLE
    if ("lorem" in low or "dolor sit" in low) and _FILLER_START.search(bare):
        return FILLER
    words = _WORD.findall(low)
    if not _MESSAGE_WORDS.isdisjoint(words) and _MESSAGE.match(bare):
        return MESSAGE
    if filler_words and len(words) >= FILLER_WORDS and words[0] in filler_words and sum(w in filler_words for w in words) >= FILLER_MATCH * len(words):
        return FILLER
    if low in _COOKIE_LINES or low.startswith(_COOKIE_STARTS):
        return COOKIE
    if low in _BOX_LINES or (low[-1:] == ":" and low.rstrip(" :") in _BOX_LINES):
        return BOX
    if furniture(low):
        return FURNITURE
    return LIST if _LIST.match(bare) else OTHER


def _mail(bare: str) -> re.Match | None:
    if "@" in bare or "[" in bare or "(" in bare or " at " in bare or " AT " in bare or " At " in bare:
        return _MAIL.search(bare)
    return None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def address_key(url: str | None) -> tuple[str, str]:
    """(host, address) without scheme, www., case, doubled and closing slashes, query and fragment."""
    bare = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().casefold())
    bare = re.sub(r"[?#].*$", "", bare).removeprefix("www.")
    host, _, path = bare.partition("/")
    return host, host + "/" + re.sub(r"/{2,}", "/", path).strip("/")


def line_facts(bare: str, filler_words: frozenset[str] = frozenset()) -> tuple[int, int, bool, tuple[int, ...]]:
    """(kind, characters that count as prose, whether it is a line of contact, hashes of its tokens) of a line.

    List items, messages and placeholders have no tokens: they are no furniture.
    """
    low = normal(bare)
    kind = lexical(bare, low, filler_words)
    mail = _mail(bare)
    contact = bool(mail and len(mail[0]) >= CONTACT_SHARE * len(bare)) or (bare[-1:].isdigit() and bool(_PHONE.fullmatch(bare)))
    prose = len(bare) if len(bare) > 60 or not _SENTENCE_MARKS.isdisjoint(bare) else 0
    keys = () if kind in (LIST, MESSAGE, FILLER, HOLE, HOLES) or (kind != OTHER and _LIST.match(bare)) else tuple(map(_hash, parts(bare, low)))
    return kind + WITH_MAIL * bool(mail), prose, contact, keys


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = list(chain.from_iterable(values))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _parser(filler_words: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, ints, longs = LINES.names, ("no", "kind", "prose", "ntok"), ("key", "keys", "contact")

    def parsed(text: str, memo: dict) -> tuple:
        lines = [line.strip() for line in text.split("\n")]
        no = [n for n, bare in enumerate(lines, 1) if bare]
        if not no:
            return (), (), (), (), (), (), ()
        facts = []
        for bare in lines:
            if bare:
                found = memo.get(bare)
                if found is None:
                    found = line_facts(bare, filler_words)
                    if len(bare) <= 100:  # longer lines are seldom repeated: they are worked out each time
                        memo[bare] = found
                facts.append(found)
        kinds, prose, marks, keys = zip(*facts)
        ntok = [len(k) for k in keys]
        key = list(chain.from_iterable(keys))
        before: tuple | set = ()
        if True in marks:  # tokens of a line of contact and of the four lines before it
            before = {k for i, of_line in enumerate(keys) if of_line and True in marks[i : i + 5] for k in of_line}
        return no, kinds, prose, ntok, key, dict.fromkeys(key), before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                src, rec, urls, texts = (part.column(c) for c in ("src", "rec_id", "url", "text"))
                addresses = [address_key(u) for u in urls.to_pylist()]
                columns = list(zip(*(parsed(t, memo) for t in texts.to_pylist())))
                if len(memo) > 200_000:
                    memo.clear()
                lists = [_lists(list(c), pa.int32() if n in ints else pa.int64()) for n, c in zip((*ints, *longs), columns)]
                yield pa.RecordBatch.from_arrays([src, rec, pa.array([_hash(a) for _, a in addresses], pa.int64()), pa.array([_hash(h) for h, _ in addresses], pa.int64()), *lists], names=names)

    return run


def _nested_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Where candidates stand on records: rank in their own class (own) or slot of the enclosing one, as lo and hi of the batch."""
    n = frame["place"].map(len).to_numpy()
    rec = np.repeat(np.arange(len(frame)), n)
    place, hk, cls, size, support = (np.concatenate([np.asarray(x, np.int64) for x in frame[c]] or [np.empty(0, np.int64)]) for c in MARK)
    order = np.lexsort((place, hk, rec))
    rec, place, hk, cls, size, support = (x[order] for x in (rec, place, hk, cls, size, support))
    first = np.ones(len(rec), bool)
    first[1:] = (rec[1:] != rec[:-1]) | (hk[1:] != hk[:-1])  # a token's role is that of its first place
    rec, place, hk, cls, size, support = (x[first] for x in (rec, place, hk, cls, size, support))
    order = np.lexsort((place, cls, -support, rec))
    rec, place, hk, cls, size, support = (x[order] for x in (rec, place, hk, cls, size, support))
    if not len(rec):
        return pd.DataFrame({"hk": np.empty(0, np.int64), "owner": np.empty(0, np.int64), "own": np.empty(0, bool), "lo": np.empty(0, np.int32), "hi": np.empty(0, np.int32), "n": np.empty(0, np.int64)})[NESTED.names]
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (cls[1:] != cls[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(rec)))
    at = np.repeat(np.arange(len(start)), count)
    whole = (count == size[start]) & (count >= MIN_SIZE)
    rank = np.arange(len(rec)) - start[at]
    # whole classes of a record from the most support to the least; the enclosing one is the last of greater support
    wide = np.flatnonzero(whole)
    level = lambda i: rec[i] * (1 << 32) + ((1 << 31) - support[i])
    up = np.searchsorted(level(start[wide]), level(np.arange(len(rec)))) - 1
    inside = up >= 0
    inside[inside] = rec[start[wide[up[inside]]]] == rec[inside]
    parent = wide[up[inside]]
    spot = at * (1 << 32) + place
    slot = np.searchsorted(spot, parent * (1 << 32) + place[inside]) - start[parent]
    mine = whole[at]
    found = pd.DataFrame({"hk": np.concatenate([hk[mine], hk[inside]]), "owner": np.concatenate([cls[mine], cls[start[parent]]]), "slot": np.concatenate([rank[mine], slot]), "own": np.repeat([True, False], [mine.sum(), inside.sum()])})
    return found.groupby(["hk", "owner", "own"], as_index=False)["slot"].agg(lo="min", hi="max", n="count").astype({"lo": np.int32, "hi": np.int32})[NESTED.names]


def slot_lengths(kinds: list[int], ntok: list[int], known: list[bool]) -> list[int]:
    """For each heading of a box, the lines after it that are nothing but known tokens."""
    found, at, ends = [], 0, []
    full = []
    for n in ntok:
        full.append(n > 0 and all(known[at : at + n]))
        at += n
    for i, kind in enumerate(kinds):
        if kind & 15 == BOX:
            ends = i + 1
            while ends < len(kinds) and kinds[ends] == OTHER and full[ends]:
                ends += 1
            found.append(ends - i - 1)
    return found


class _Column:
    """A list column of an Arrow batch: its values at once, and the place of each row's."""

    def __init__(self, batch: pa.RecordBatch, name: str):
        column = batch.column(name)
        self.at = column.offsets.to_numpy()
        self.flat = column.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.flat[self.at[row] : self.at[row + 1]]

    def rows(self) -> Iterator[list]:
        flat, at = self.flat[self.at[0] : self.at[-1]].tolist(), (self.at - self.at[0]).tolist()
        return (flat[i:j] for i, j in zip(at, at[1:]))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_nested_of`` for records (key, kind, ntok) with the candidates of their host, and slot lengths of boxes."""
    for batch in batches:
        marks: dict[str, list] = {c: [] for c in MARK}
        boxes: Counter = Counter()
        hosts: dict[int, dict] = {}
        given = [_Column(batch, f"c_{c}") for c in ("key", *MARK[1:])]
        kinds, ntoks = _Column(batch, "kind"), _Column(batch, "ntok")
        for row, (host, key) in enumerate(zip(batch.column("host").to_pylist(), _Column(batch, "key").rows())):
            of_key = hosts.get(host)
            if of_key is None:  # each row brings the candidates of its host: read once for all its records here
                of_key = hosts[host] = dict(zip(given[0][row].tolist(), zip(*(g[row].tolist() for g in given[1:]))))
            hit = [(place, of_key[k]) for place, k in enumerate(key) if k in of_key]
            marks["place"].append([p for p, _ in hit])
            for c, column in enumerate(MARK[1:]):
                marks[column].append([x[c] for _, x in hit])
            kind = kinds[row] & 15
            if (kind == BOX).any():
                boxes.update(slot_lengths(kind.tolist(), ntoks[row].tolist(), [k in of_key for k in key]))
        found = _nested_of(pd.DataFrame(marks))
        counted = pd.DataFrame([(length, BOXES, 0, 0, True, n) for length, n in boxes.items()], columns=NESTED.names)
        both = pd.concat([found, counted.astype({"lo": np.int32, "hi": np.int32, "own": bool})], ignore_index=True) if len(counted) else found
        yield pa.RecordBatch.from_arrays([pa.array(both[n].to_numpy(), k) for n, k in zip(NESTED.names, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], names=NESTED.names)


def judge(no: list[int], kinds: list[int], prose: list[int], ntok: list[int], known: list[bool], slot: int) -> tuple[list[int], str | None]:
    """(numbers of the body lines, kind of residue or None) of a record; ``known``: which tokens are furniture."""
    at, left, messages, holes = 0, 0, 0, 0
    strong = filled = False
    body, rest, prose_left = [], [], 0
    for i, code in enumerate(kinds):
        kind, n = code & 15, ntok[i]
        if kind == OTHER and n and sum(known[at : at + n]) >= MIN_SHARE * n:
            kind = FURNITURE
        at += n
        if kind == BOX:
            left = slot
            continue
        if left and kind in (OTHER, LIST, FURNITURE) and not code & WITH_MAIL:
            left -= 1
            continue
        if kind != COOKIE:
            left = 0
        if kind in (OTHER, LIST):
            body.append(no[i])
            prose_left += prose[i]
        elif kind in (MESSAGE, FILLER):
            messages += 1
            filled = filled or kind == FILLER
            rest.append(no[i])
        elif kind in (HOLE, HOLES):
            holes += 1
            strong = strong or kind == HOLES
            rest.append(no[i])
    if holes > 1 or strong:
        return [], "placeholder"
    if filled:
        return [], "filler"
    if messages and prose_left <= 200 and len(body) <= 3 * messages + 1:
        return [], "message"
    return sorted(body + rest), None


def _judge(slot: int, vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``vocabulary``: a broadcast sorted array of tokens, or None where each row has those it holds in ``common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = None if vocabulary is None else vocabulary.value
        for batch in batches:
            hosts: dict[int, set] = {}
            keys, templates = _Column(batch, "key"), _Column(batch, "template")
            flat = keys.flat[keys.at[0] : keys.at[-1]]
            if everywhere is None:
                held, common = batch.column("common").to_pylist(), [False] * len(flat)
            else:
                spot = np.minimum(np.searchsorted(everywhere, flat), len(everywhere) - 1)
                held, common = None, (everywhere[spot] == flat).tolist() if len(everywhere) else [False] * len(flat)
            at, body, residues = 0, [], []
            lists = zip(*(_Column(batch, c).rows() for c in ("no", "kind", "prose", "ntok", "key")))
            for row, (host, (no, kind, prose, ntok, key)) in enumerate(zip(batch.column("host").to_pylist(), lists)):
                own = hosts.get(host)
                if own is None:
                    own = hosts[host] = set(templates[row].tolist())
                here = own.union(held[row]) if held and held[row] else own
                known = [c or k in here for k, c in zip(key, common[at : at + len(key)])]
                at += len(key)
                lines, residue = judge(no, kind, prose, ntok, known, slot)
                body.append(lines)
                residues.append(residue)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("rec_id"), _lists(body, pa.int32()), pa.array(residues, pa.string())], names=JUDGED.names)

    return run


def records(df: DataFrame, src: str, id_col: str, url_col: str, text_col: str) -> DataFrame:
    return df.select(F.lit(src).alias("src"), F.col(id_col).cast("bigint").alias("rec_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def filler_words(recs: DataFrame) -> frozenset[str]:
    """Words that lines of filler use on at least ``MIN_HOSTS`` hosts, and ``FILLER_SHARE`` of the hosts that have such lines.

    The share bounds their number: (words of filler per host) / ``FILLER_SHARE`` at most, whatever the number of rows.
    """
    low = F.lower("text")
    some = recs.filter(F.col("text").rlike("(?i)lorem|dolor sit")).select(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"), F.explode(F.split(low, "\n")).alias("line"))
    lines = some.filter(F.col("line").rlike(r"\blorem\s+ipsum\b|\bdolor\s+sit\s+amet\b")).select("host", F.regexp_extract_all("line", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    words = cut_lineage(lines.filter(F.size("words") >= FILLER_WORDS).select("host", F.explode("words").alias("word")).distinct())
    hosts = words.select("host").distinct().count()
    if not hosts:
        return frozenset()
    found = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(MIN_HOSTS, FILLER_SHARE * hosts)).select("word").collect()
    return frozenset(r["word"] for r in found)


def parsed_lines(recs: DataFrame) -> DataFrame:
    """The rows of ``LINES``, one per record."""
    return recs.select("src", "rec_id", "url", "text").mapInArrow(_parser(filler_words(recs)), LINES)


def classes_of(lines: DataFrame) -> DataFrame:
    """Classes of enough pages by token: host, key, support, contact, class_id (hash of host and occurrence vector)."""
    # of repeated fetches the last one; where an address has several sources, the tokens of all of them
    last = lines.groupBy("url", "src").agg(F.max_by(F.struct("host", "keys", "contact"), "rec_id").alias("x"))
    address = last.groupBy("url").agg(F.min("x.host").alias("host"), F.array_distinct(F.flatten(F.collect_list("x.keys"))).alias("keys"), F.flatten(F.collect_list("x.contact")).alias("contact"))
    tokens = address.select("host", "url", "contact", F.explode("keys").alias("key")).select("host", "key", F.xxhash64("url").alias("v"), F.array_contains("contact", F.col("key")).cast("long").alias("c"))
    found = tokens.groupBy("host", "key").agg(F.count("*").alias("support"), F.sum("c").alias("c"), F.bit_xor("v").alias("v")).filter(F.col("support") >= MIN_PAGES)
    hosts = lines.select("host", "url").distinct().groupBy("host").agg(F.count("*").alias("addresses"))
    found = found.join(hosts, "host").filter(F.col("support") >= MIN_SUPPORT * F.col("addresses"))
    return found.select("host", "key", F.col("support").cast("int").alias("support"), (F.col("c") / F.col("support")).alias("contact"), F.xxhash64("host", "support", "v").alias("class_id"))


def vocabulary(classes: DataFrame) -> DataFrame:
    """(key, furniture) of tokens that several hosts repeat: furniture on most of them, or else content on all."""
    hosts = classes.groupBy("key").agg(F.count_if(F.col("contact") <= MAX_CONTACT).alias("hosts"), F.count("*").alias("all"))
    return hosts.filter(F.col("all") >= MIN_HOSTS).select("key", ((F.col("hosts") >= MIN_HOSTS) & (F.col("hosts") >= MOST * F.col("all"))).alias("furniture"))


def candidates(classes: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens of a host that may be its template: host, key, hk (hash of both), class_id, size (tokens of the class), support."""
    local = classes.filter(F.col("contact") <= MAX_CONTACT).join(known.filter("not furniture"), "key", "left_anti")
    sizes = local.groupBy("class_id").agg(F.count("*").cast("int").alias("size"))
    return local.join(sizes, "class_id").select("host", "key", F.xxhash64("host", "key").alias("hk"), "class_id", "size", "support")


def judged(recs: DataFrame) -> DataFrame:
    """(src, rec_id, body, residue) of every record: numbers of body lines; residue is NULL for real pages."""
    lines = cut_lineage(parsed_lines(recs))
    hosts = cut_lineage(lines.groupBy("host").agg(F.count("*").alias("records")))
    classes = cut_lineage(classes_of(lines))
    known = cut_lineage(vocabulary(classes))
    local = cut_lineage(candidates(classes, known))
    # candidates of a host as one row: bounded, see above
    fields = ("key", *MARK[1:])
    wanted = local.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("c")).join(hosts, "host").select("host", "records", *[F.col(f"c.{n}").alias(f"c_{n}") for n in fields])
    met = lookup_join(lines.select("host", "rec_id", "key", "kind", "ntok"), wanted, "host", "rec_id", "records")
    seen = cut_lineage(met.select("host", "key", "kind", "ntok", *[f"c_{n}" for n in fields]).mapInArrow(_nested, NESTED).groupBy("hk", "owner", "own").agg((F.min("lo") == F.max("hi")).alias("one"), F.sum("n").alias("n")))
    # the length of a box's slot: the commonest of those with known lines, the shortest on ties; none known, no slot
    lengths = seen.filter((F.col("owner") == BOXES) & (F.col("hk") > 0)).orderBy(F.col("n").desc(), "hk").limit(1).collect()
    slot = int(lengths[0]["hk"]) if lengths else 0
    classed = seen.filter(F.col("owner") != BOXES)
    ordered = classed.filter("own").groupBy("owner").agg(F.min("one").alias("one")).filter("one").select("owner")
    valid = classed.join(ordered, "owner").groupBy("hk").agg(F.min("one").alias("one")).filter("one").select("hk")
    template = local.join(valid, "hk", "left_semi").groupBy("host").agg(F.collect_list("key").alias("template"))
    template = hosts.join(template, "host", "left").withColumn("template", F.coalesce("template", F.array().cast("array<bigint>")))
    rows = lookup_join(lines.select("src", "rec_id", "host", "no", "kind", "prose", "ntok", "key"), template, "host", "rec_id", "records")
    return _with_vocabulary(rows, known.filter("furniture").select("key"), slot)


def _with_vocabulary(rows: DataFrame, common: DataFrame, slot: int, most: int = VOCABULARY) -> DataFrame:
    columns = ("src", "rec_id", "host", "no", "kind", "prose", "ntok", "key", "template")
    if common.count() <= most:
        everywhere = np.sort(np.array([r["key"] for r in common.collect()], np.int64))
        return rows.select(*columns).mapInArrow(_judge(slot, rows.sparkSession.sparkContext.broadcast(everywhere)), JUDGED)
    held = rows.select("src", "rec_id", F.explode(F.array_distinct("key")).alias("key")).join(common, "key").groupBy("src", "rec_id").agg(F.collect_list("key").alias("common"))
    return rows.join(held, ["src", "rec_id"], "left").select(*columns, "common").mapInArrow(_judge(slot, None), JUDGED)


def body_lines(recs: DataFrame) -> DataFrame:
    return judged(recs).filter("residue is null").select("src", "rec_id", F.explode("body").alias("line_no"))


def residues(recs: DataFrame) -> DataFrame:
    return judged(recs).filter("residue is not null").select("src", "rec_id", "residue")


def body_text(text: Column, lines: Column) -> Column:
    """The body as text, its lines in order."""
    every = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda no: F.element_at(every, no)), "\n")
