"""Word lists and patterns. Fixed values, in their natural order; callers can pass their own."""

from __future__ import annotations

#: Fixed values.
EDUCATION = [
    "studii", "a studiat", "studia", "facultate", "universitate", "liceu", "școala", "școală", "absolvent", "absolvit", "absolvă",
    "diplomă", "masterat", "master în", "master in", "masterul", "doctorat", "specializare", "studii superioare", "licență",
]
#: Fixed values.
FUNDING = [
    "finanțare", "finanțat", "finanța", "finanțăm", "bani", "buget", "fonduri", "fond european", "pnrr", "grant", "împrumut",
    "investiție", "investiții", "subvenție", "subvenții", "venituri", "taxe", "impozite", "accize", "cofinanțare",
    "parteneriat public-privat",
]
#: Fixed values; a trailing blank counts.
PROMISE = [
    "voi ", "vom ", "va construi", "va face", "va introduce", "va investi", "va finanța", "va aloca", "va crea", "va crește",
    "va reduce", "va elimina", "va reforma", "ne angajăm", "mă angajez", "ne-am angajat", "promit", "promite", "promisiune",
    "planul este", "intenționăm", "intenționez",
]
#: Label and its words.
CHANNELS = [
    ("buget de stat", ["bugetul de stat", "buget de stat"]),
    ("buget local", ["bugetul local", "buget local"]),
    ("fonduri europene", ["fonduri europene", "fondurile europene", "fond european"]),
    ("PNRR", ["pnrr"]),
    ("granturi", ["grant", "granturi"]),
    ("împrumuturi", ["împrumut", "împrumuturi"]),
    ("taxe și impozite", ["taxe", "impozite", "accize"]),
    ("subvenții", ["subvenție", "subvenții"]),
    ("cofinanțare", ["cofinanțare"]),
    ("investiții private", ["investitor privat", "investiții private", "capital privat"]),
    ("parteneriat public-privat", ["parteneriat public-privat"]),
]
#: Kind and pattern, the first that fits counts.
KINDS = [
    ("stenogramă", "steno|sedint|plen"),
    ("discurs", "discurs|alocu|adresare|mesaj"),
    ("interviu", "interviu|invitat|emisiun"),
    ("comunicat", "comunicat|press"),
    ("declarație", "declar|intervent|conferint"),
    ("educație", "educat|stud|facultat|univers|liceu|scoal|biograf"),
    ("finanțare", "finant|buget|fondur|pnrr|grant|investit|tax|impozit"),
]
#: Addresses and anchors worth following.
URL_WORDS = (
    "steno|discurs|declar|interviu|comunicat|alocu|intervent|sedint|plen|mesaj|conferint|educat|stud|facultat|univers|finant|buget|"
    "fondur|pnrr|grant|investit|tax|impozit|biograf|profil"
)
#: Fixed value.
SPEECH_URL = "steno|discurs|declar|interviu|comunicat|conferint|plen|sedint"
#: Fixed value.
TOPIC_URL = "educat|stud|univers|facultat|liceu|finant|buget|fondur|pnrr|grant|investit|biograf"
#: Fixed value.
SPEAKER = (
    r"(?s)^(?:[Dd]omnul|[Dd]oamna|D-l|D-na)?\s*([A-ZĂÂÎȘȚŞŢ](?U:[\w\-])+(?:\s+[A-ZĂÂÎȘȚŞŢ](?U:[\w\-])+){1,4})\s*(?:\([^)]{0,100}\))?\s*:\s*(.*)$"
)
#: Fixed value.
QUOTE = '(?s)[„“"«]([^”"“„«»]{40,5000})[”"»]'
#: Cue and pattern on folded text.
CUES = [
    ("absolute language", r"\b(niciodata|intotdeauna|mereu|toti|toate|nimeni|nimic|absolut|complet|total|fara exceptie|oricand|nicio|niciun|zero|100 ?%|100 la suta)\b"),
    ("numeric claim", r"\d"),
    ("conspiracy vocabulary", "complot|conspirati|agenda ascunsa|retea secreta|guvern(?:ul)? din umbra|stat paralel|globalis|mondialis|marele reset|plandemi|cabala|ne ascund|ni se ascunde|ne manipulez|puteri oculte|new world order|ordine de la|controlat[ae]? din afara"),
    ("unnamed authority", "studii (?:arata|spun|dovedesc)|specialistii (?:spun|arata)|toata lumea stie|se stie ca|este evident ca|oamenii spun|expertii (?:spun|arata)|multi spun"),
    ("sweeping causal claim", "din cauza|din vina|vina (?:este|e) a|datorita faptului"),
    ("accusation", r"\b(?:minte|mint|hoti|hot|tradator|corup|vandut|infractor|trada)\w*"),
]
#: Fixed value.
PROMISE_CUE = "promise / future commitment"
#: Fixed value.
ATTRIBUTION = (
    r"\b(?:a (?:mai )?(?:spus|declarat|afirmat|sustinut|precizat|anuntat|explicat|acuzat|adaugat|subliniat|mentionat|transmis|promis|"
    r"reiterat|insistat|scris|aratat|criticat|replicat|raspuns|dezvaluit)|(?:spune|afirma|declara|sustine|considera|crede|promite|"
    r"anunta|acuza) ca|potrivit|conform|in opinia)\b"
)
#: Fixed values.
STOPWORDS = (
    "acest aceasta aceste acestea acesta acestei acestui acolo adica aceea acele acelea acelor ainte alta alte altele altfel anul "
    "anului asta astfel atunci avem aveti avand avea bine cand care carei caror carui cate catre chiar cine cineva cred daca dupa desi "
    "doar deja dintre foarte fost fiind fiecare face facut fara iata inca intre langa lucru mult multe multi nostru noastra noastre "
    "nostri nimic niste noua oricare pentru poate pana prin putea sunt sale sau sale spre sunt suntem toate toti tot trebuie unde unui "
    "unei unor vom voi vreau vrem vedem vorbim zicem acum aici apoi cat cum deci ceea ceva cele cei cel este fie era erau sunteti ale"
).split()
#: Fixed value.
NEGATION = r"\b(?:nu|nici|niciodata|fara|nicio|niciun|nimeni|nimic)\b"
#: Fixed value.
NUMBER = r"\d+(?:[.,]\d+)?"
#: Fixed values of the first version: opinion words, commitments and outcomes.
POSITIVE = r"(?iU)\b(?:laud[ăa]\w*|apreci\w+|succes\w*|reu[șs]it\w*|competen\w+|onest\w*|eficien\w*|curajos\w*|credibil\w*|admir\w+|performan\w+|transparen\w+|integr\w+|salut\w*|pozitiv\w*|inspir\w+)"
NEGATIVE = r"(?iU)\b(?:critic\w*|acuz\w*|e[șs]ec\w*|scandal\w*|minciun\w*|\bminte\b|incompeten\w*|demagog\w*|populis\w*|dezam[ăa]g\w*|contest\w*|controvers\w*|nereu[șs]\w*|gre[șs]eal\w*|gre[șs]it\w*|corup\w*|manipul\w*|ineficien\w*|ezit\w*|ambigu\w*|nem[ăa]rginit)"
STRONG = r"(?iU)promit\w*|angaj\w*|garant\w*|v[ăa] asigur|[îi]mi asum|jur c[ăa]"
WEAK = r"(?iU)\bvom\s+\w+|\bvoi\s+\w+|\bo s[ăa]\s+\w+|\bam s[ăa]\s+\w+|\bnu vom\b|\bnu voi\b"
SPEECH = r"(?iU)a spus|a declarat|a afirmat|a anun[țt]at|a promis|a transmis|spune|declar[ăa]|" + '"|„'
KEPT = r"(?iU)realizat|finalizat|implementat|inaugurat|intrat [îi]n vigoare|adoptat|votat|promulgat|dat [îi]n folosin[țt][ăa]|[îi]ndeplinit|[îi][șs]i-a [țt]inut|respectat promisiunea|aprobat"
BROKEN = r"(?iU)nerespectat|ne[îi]ndeplinit|nu [îi][șs]i-a [țt]inut|nu a (fost )?(realizat|finalizat|respectat|[îi]ndeplinit|implementat|adoptat)|nu s-a (realizat|finalizat)|[îi]nc[ăa]lcat|a renun[țt]at|am[âa]nat|a e[șs]uat|neonorat|a revenit asupra"
