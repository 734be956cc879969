"""Fixed values that results depend on: word lists, patterns and limits, stated as they are."""

# Families of domain terms, a canonical term and its variants.
SYNONYMS = {
    "storno": ["annullo", "annulla", "storni e annulli", "cancellazione articolo", "storna"],
    "storno scontrino": ["annullo scontrino", "annulla scontrino", "cancellazione scontrino", "annullamento scontrino", "cancellare lo scontrino"],
    "apertura cassa": ["apro la cassa", "apertura di cassa", "inizio giornata", "inizio turno", "accensione cassa", "fondo cassa", "apertura turno"],
    "chiusura fiscale": ["chiusura giornaliera", "report z", "chiusura z", "azzeramento", "modalita z", "chiudo la cassa", "chiusura cassa", "fine giornata", "chiusura di cassa", "fine turno"],
    "impulso cassetto": ["apertura cassetto", "apri cassetto", "cassetto rendiresto"],
    "letture": ["modalita x", "report x", "lettura x", "report intermedio", "lettura giornaliera", "lettura periodica", "letture statistiche"],
    "reso merce": ["reso parziale", "reso", "rimborso", "nota di credito", "pratica di reso"],
    "sostituzione rotolo": ["cambio rotolo", "cambio carta", "carta esaurita", "fine carta", "rotolo scontrino", "carta finita", "inserire rotolo", "rotolo", "rotolo carta"],
    "giornale elettronico": ["dgfe", "mmc", "sostituzione giornale elettronico", "memoria dgfe", "scarico dgfe", "multi media card"],
    "collegamento pos": ["abbinamento pos", "pairing pos", "configurazione pos", "collegare il pos", "terminale pagamento", "pagamento elettronico", "pos"],
    "tipi pagamento": ["forme di pagamento", "pagamenti misti", "modalita di pagamento"],
    "connessione wifi": ["wifi", "rete wireless", "collegamento rete", "connessione di rete"],
    "programmazione iva": ["aliquota", "aliquote iva", "impostazione iva", "reparti iva", "codice iva"],
    "scorporo iva": ["scorporo", "imponibile", "stampa imponibile"],
    "obblighi fiscali": ["fiscalizzazione", "dichiarazione di installazione", "verifica periodica", "libretto fiscale", "conformita fiscale"],
    "data ora": ["data/ora", "data e ora", "impostazione data", "impostazione ora", "ora legale", "ora solare", "cambio ora", "orologio"],
    "intestazione scontrino": ["logo scontrino", "ragione sociale scontrino", "testata scontrino", "piedino scontrino", "logo grafico", "logo"],
    "blocco tastiera": ["tastiera bloccata", "sblocco tastiera"],
}

# Function words of the queries' language.
FUNCTION_WORDS = """
il lo la i gli le un uno una
del dello della dei degli delle al allo alla ai agli alle
dal dallo dalla dai dagli dalle nel nello nella nei negli nelle
sul sullo sulla sui sugli sulle col coi
di a da in con su per tra fra e o ed od
che non si ci ne ha ho hai anno mi ti vi lo li
ma se come cosa quando dove quale quali piu meno
""".split()

# Words that open a question of its own.
INTERROGATIVES = "come cosa quando dove quale quali perche perché chi quanto quanti quanta quante posso devo dove'".split()
MOST_REPLY_WORDS = 6

# Patterns, in Java's dialect.
TOKEN = r"(?iu)[0-9a-zà-ÿ]+"
WORD = r"[\p{L}\p{N}_]+"
FIRMWARE = r"(?i)\b(?:firmware|fw|versione)\s*[:\-]?\s*(v?[0-9]+(?:\.[0-9]+){0,2})"
ERROR_CODE = r"(?i)\b([A-Z])-?(\d{2,3})\b"
ERROR_CODE_IN_CONTEXT = r"(?i)\b(?:errore|codice)(?:\s+errore)?\s*:?\s*([A-Z])?\s?-?\s?(\d{2,3})\b"
SECTION_HEADER = r"(?:[1-9]\d?(?:\.\d{1,2}){0,2}[.)]?\s+[A-ZÀ-Ù].{3,80}|(?:CAPITOLO|Capitolo|SEZIONE|Sezione)\s+\d+.{0,80}|(?:Passo|PASSO)\s+\d+.{0,80})"
LEADING_NUMBER = r"(?i)^\s*(?:\d{1,2}(?:\.\d{1,2}){0,2}[.)]?|CAPITOLO\s+\d+|SEZIONE\s+\d+)\s*[-–:]?\s*"
NON_PROCEDURAL = r"(?i)^(sommario|indice|appendice|glossario|premessa|introduzione|note|informazioni agli utenti|descrizione generale|caratteristiche tecniche)\b"
ACRONYMS = ["IVA", "DGFE", "MMC", "POS", "PC", "X", "Z", "WIFI", "RCH"]
TITLE_CHARS = (8, 70)
TITLE_TRIM = " .:-–\t"

# Limits of typo correction.
LEAST_CORRECTED_CHARS = 5
SHORT_WORD_CHARS = 6
EDITS_SHORT, EDITS_LONG = 1, 2
WINDOW_WORDS = (2, 3)
LEAST_WINDOW_CHARS = 5
OCR_LEAST_NATIVE_CHARS, OCR_LEAST_CHARS = 40, 20


def vocabulary() -> list[str]:
    """All domain terms in alphabetical order."""
    return sorted({t for k, v in SYNONYMS.items() for t in (k, *v)})


def synonym_rows() -> list[tuple[int, str, str, int]]:
    """(family, canonical, term, place): of each family its canonical term at place 0, then the variants."""
    return [(n, k, t, p) for n, (k, v) in enumerate(SYNONYMS.items()) for p, t in enumerate((k, *v))]
