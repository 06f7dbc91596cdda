"""Freely typed values mapped to the entries of a canonical list (problem 1).

A symmetric-delete dictionary of the list is built once and broadcast: every spelling of an entry is stored under itself
and under what is left when up to two letters are deleted, so that a value finds all spellings within that edit distance by
lookups of its own deletions. Hits are ranked by weighted Damerau-Levenshtein distance and by how often the data name the
entry. A list of any length is taken in blocks of bounded size.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.session import collect_bounded, cut

#: Entries of a block of the list, whose dictionary is broadcast (some 100 deletions an entry).
BLOCK_ENTRIES = 50_000
DISTANCE = 2

# Additions to a job title that don't change which title it is. Phrases first, then single words.
TITLE_PHRASES = (
    "m w d|w m d|m f d|f m d|m f x|all genders|immediate start|immediate starter|sign on bonus|signing bonus|part time|full time|entry level|mid level|senior level|junior level|day shift|night shift|evening shift|swing shift|late shift|early shift|weekend shift"
    "|first shift|second shift|third shift|1st shift|2nd shift|3rd shift|west region|east region|north region|south region|central region|new rate|work from home|home office|fixed term|team \\d+|req \\d+|requisition \\d+|job \\d+|id \\d+|ref \\d+|shift \\d+|year round|multiple openings|urgently hiring|now hiring|w 2|c 2 c"
)
TITLE_WORDS = (
    "senior sr snr junior jr jnr lead principal staff experienced entry associate ii iii iv v i vi 1 2 3 remote hybrid onsite contract contractor travel prn temp temporary seasonal weekend weekends weekday weekdays nights days evenings"
    " urgent new permanent perm freelance internship trainee graduate apprentice mid chief head level shift bonus locum casual per diem relocation usa us uk"
)
#: Words that may be additions or part of a title; both readings are tried.
TITLE_EITHER = {"staff", "associate", "chief", "head", "lead", "contractor", "contract", "trainee", "level"}
# Abbreviations in titles.
TITLE_SHORT = {
    "mgr": "manager", "mngr": "manager", "mgmt": "management", "anlst": "analyst", "analyt": "analyst", "eng": "engineer", "engr": "engineer", "asst": "assistant", "assist": "assistant", "tech": "technician|technologist", "dev": "developer",
    "spec": "specialist", "admin": "administrator|administrative", "adm": "administrator|administrative", "oper": "operator", "op": "operator", "coord": "coordinator", "rep": "representative", "assoc": "associate", "supv": "supervisor", "supvr": "supervisor", "elec": "electrical",
    "mech": "mechanical|mechanic", "vet": "veterinary", "fin": "financial", "prod": "production|product", "whse": "warehouse", "mktg": "marketing", "maint": "maintenance", "qa": "quality assurance", "qual": "quality", "lab": "laboratory", "hr": "human resources",
    "ux": "user experience", "sw": "software", "fe": "frontend", "be": "backend", "exec": "executive", "acct": "account|accountant", "cust": "customer", "svc": "service", "sr": "", "dir": "director", "env": "environmental", "struct": "structural",
    "res": "researcher", "mfg": "manufacturing", "info": "information", "sys": "systems", "db": "database", "ml": "machine learning", "med": "medical", "occ": "occupational", "phys": "physical|physician", "resp": "respiratory", "surg": "surgical", "reg": "registered",
    "elem": "elementary", "hs": "high school", "proc": "procurement", "log": "logistics", "inv": "inventory", "comp": "compliance", "auto": "automotive", "rn": "registered nurse", "lpn": "licensed practical nurse", "ins": "insurance", "bus": "business|bus", "cyber": "cybersecurity",
    "ops": "operations", "proj": "project", "prog": "program", "prop": "property", "soc": "social", "tchr": "teacher", "dsgnr": "designer", "instr": "instructor", "int": "interior",
}
# Other names of titles, several after a bar.
TITLE_ALIASES = {
    "Registered Nurse": "rn|r n|staff nurse|reg nurse|krankenpfleger|krankenschwester|infirmier|enfermera|enfermero", "Licensed Practical Nurse": "lpn|l p n|lvn|licensed vocational nurse", "Nurse Practitioner": "np|arnp|aprn|fnp|crnp", "Physician Assistant": "pa|pa c|p a|physician associate",
    "Software Engineer": "swe|software developer|softwareentwickler|programmer|sde|coder|software dev|ingeniero de software|developpeur", "Machine Learning Engineer": "mle|ml engineer", "Site Reliability Engineer": "sre", "Database Administrator": "dba|datenbankadministrator", "User Experience Researcher": "ux researcher|uxr",
    "Quality Assurance Engineer": "qa engineer|qa tester|test engineer|sdet|quality engineer|software tester", "Human Resources Manager": "hr manager|hrm|people manager|personalleiter", "Systems Administrator": "sysadmin|sys admin|system administrator|systemadministrator", "Frontend Developer": "front end developer|fe dev|fe developer|front end dev|front end engineer|frontend engineer",
    "Backend Developer": "back end developer|be dev|be developer|back end dev|back end engineer|backend engineer", "Customer Service Representative": "csr|customer care rep|customer care representative|customer service agent|call center agent|customer support representative", "Hair Stylist": "hairdresser|hairstylist|friseur|coiffeur",
    "Restaurant Server": "waiter waitress|waiter|waitress|server|kellner|waitstaff|serveur|camarero", "Truck Driver": "cdl a driver|cdl driver|trucker|lkw fahrer|cdl a truck driver|lorry driver|otr driver", "Electrician": "elektriker|electricien|electricista", "Accountant": "buchhalter|cpa|contable|comptable",
    "Physical Therapist": "physiotherapist|physio|physiotherapeut|pt", "Automotive Technician": "auto mechanic|car mechanic|automotive mechanic|auto tech|kfz mechatroniker|auto technician", "Real Estate Agent": "realtor|estate agent|real estate salesperson", "Sales Representative": "sales rep|salesperson|sales agent",
    "Janitor": "custodian|hausmeister|caretaker", "Pharmacist": "apotheker", "Bank Teller": "teller", "Medical Assistant": "ma|cma", "Home Health Aide": "hha", "Administrative Assistant": "admin assistant|secretary|admin asst", "Executive Assistant": "ea", "Mechanical Engineer": "maschinenbauingenieur", "Chief of Staff": "cos",
    "Firefighter": "fireman|fire fighter", "Flight Attendant": "stewardess|cabin crew|air hostess", "Paramedic": "emt p", "Recruiter": "talent acquisition specialist", "Speech Language Pathologist": "slp|speech therapist", "Occupational Therapist": "ot", "Web Developer": "web dev|webentwickler", "Business Analyst": "ba",
    "Data Scientist": "ds", "Product Manager": "pm|produktmanager", "Project Manager": "projektleiter", "Plumber": "klempner|plombier|fontanero", "Carpenter": "tischler|schreiner|joiner", "Baker": "backer|boulanger|panadero", "Cybersecurity Analyst": "cyber security analyst|infosec analyst|information security analyst|soc analyst",
    "Dietitian": "dietician|nutritionist", "Copywriter": "copy writer", "Bookkeeper": "book keeper", "Optometrist": "optician", "Phlebotomist": "phleb", "Underwriter": "insurance underwriter", "Veterinary Technician": "vet tech|veterinary tech|vet nurse", "HVAC Technician": "hvac tech|hvac mechanic|hvac installer",
    "Graphic Designer": "grafikdesigner", "Welder": "schweisser|soudeur|soldador", "Line Cook": "koch|cook", "Elementary School Teacher": "grundschullehrer|primary school teacher", "Security Guard": "security officer|wachmann", "Groundskeeper": "grounds keeper", "Radiologic Technologist": "rad tech|x ray tech|radiographer|radiologic tech",
    "Surgical Technologist": "surgical tech|scrub tech", "Mobile Developer": "app developer|ios developer|android developer", "Warehouse Associate": "warehouse worker|lagermitarbeiter|warehouse operative", "Housekeeper": "room attendant", "Delivery Driver": "courier|kurierfahrer", "Attorney": "lawyer",
}

# Names of states, provinces and countries by code.
REGIONS = {
    "AL": "alabama|ala", "AK": "alaska", "AZ": "arizona|ariz", "AR": "arkansas|ark", "CA": "california|calif|cal", "CO": "colorado|colo", "CT": "connecticut|conn", "DE": "delaware|del", "DC": "district of columbia", "FL": "florida|fla", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois|ill",
    "IN": "indiana|ind", "IA": "iowa", "KS": "kansas|kans", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts|mass", "MI": "michigan|mich", "MN": "minnesota|minn", "MS": "mississippi|miss", "MO": "missouri", "MT": "montana|mont", "NE": "nebraska|nebr|neb", "NV": "nevada|nev",
    "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico|n mex", "NY": "new york|n y", "NC": "north carolina|n carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma|okla", "OR": "oregon|ore", "PA": "pennsylvania|penn|penna", "RI": "rhode island", "SC": "south carolina", "SD": "south dakota",
    "TN": "tennessee|tenn", "TX": "texas|tex", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington|wash", "WV": "west virginia", "WI": "wisconsin|wis|wisc", "WY": "wyoming|wyo",
    "Ontario": "on|ont", "Quebec": "qc|que", "British Columbia": "bc|b c", "New South Wales": "nsw", "Victoria": "vic", "Queensland": "qld", "Bavaria": "bayern|by", "North Rhine-Westphalia": "nrw|nordrhein westfalen", "Hesse": "hessen|he", "Ile-de-France": "idf", "Catalonia": "cataluna|catalunya", "Lombardy": "lombardia", "England": "eng",
    "Scotland": "sco", "Karnataka": "ka", "Maharashtra": "mh", "Tamil Nadu": "tn", "Telangana": "ts|tg", "Mazovia": "mazowieckie", "Auvergne": "auvergne rhone alpes",
}
COUNTRIES = {
    "US": "us|usa|u s|u s a|united states|united states of america|america", "GB": "gb|uk|u k|united kingdom|great britain|britain|england", "IE": "ie|ireland|irl", "DE": "de|germany|deutschland|ger|deu", "AT": "at|austria|osterreich|oesterreich|aut", "CH": "ch|switzerland|schweiz|suisse|che", "FR": "fr|france|fra",
    "ES": "es|spain|espana|esp", "PT": "pt|portugal|prt", "IT": "it|italy|italia|ita", "PL": "pl|poland|polska|pol", "CZ": "cz|czechia|czech republic|cze", "DK": "dk|denmark|danmark|dnk", "SE": "se|sweden|sverige|swe", "IN": "in|india|ind|bharat", "JP": "jp|japan|jpn|nippon", "AU": "au|australia|aus", "CA": "ca|canada|can",
}
# Other names of cities.
CITY_ALIASES = {
    "New York": "nyc|n y c|new york city|manhattan|ny city|big apple", "Los Angeles": "la|l a|los angles", "San Francisco": "sf|s f|san fran|frisco|sf bay area|bay area|san francisco bay area", "Philadelphia": "philly|phila", "Las Vegas": "vegas", "New Orleans": "nola|n o l a", "Oklahoma City": "okc|okla city", "St. Louis": "stl|saint louis|st louis", "Minneapolis": "mpls",
    "Salt Lake City": "slc|salt lake", "Kansas City": "kc|k c", "Indianapolis": "indy", "Cincinnati": "cincy", "Pittsburgh": "pgh|pitt", "Baltimore": "bmore|balto", "Jacksonville": "jax", "Atlanta": "atl", "Chicago": "chi|chitown", "Dallas": "dfw", "Detroit": "det", "Boston": "bos", "Denver": "den", "San Antonio": "sa tx|san antone|satx",
    "San Diego": "sd", "Albuquerque": "abq", "Milwaukee": "mke", "Nashville": "nash", "Charlotte": "clt", "Grand Rapids": "gr mi", "Baton Rouge": "br la", "Fort Worth": "ft worth", "Houston": "htx|hou", "Phoenix": "phx", "Portland": "pdx", "Seattle": "sea", "Honolulu": "hnl", "Washington": "dc", "Raleigh": "rdu", "Sacramento": "sac|sacto", "Louisville": "lou",
    "Vienna": "wien", "Prague": "praha", "Warsaw": "warszawa", "Geneva": "geneve|genf|ginevra", "Munich": "munchen|muenchen", "Cologne": "koln|koeln", "Zurich": "zuerich", "Milan": "milano", "Rome": "roma", "Lisbon": "lisboa", "Copenhagen": "kobenhavn|koebenhavn", "Frankfurt": "frankfurt am main|frankfurt a m|frankfurt main|ffm", "Chennai": "madras",
    "Mumbai": "bombay", "Bengaluru": "bangalore|blr", "Montreal": "mtl", "Toronto": "tor|yyz", "Vancouver": "yvr", "Barcelona": "bcn", "Tokyo": "tokio", "Brisbane": "bne", "Melbourne": "melb", "Sydney": "syd", "Dublin": "baile atha cliath", "Edinburgh": "edinburg", "Manchester": "mcr", "London": "londres|ldn", "Paris": "parigi",
    "Hyderabad": "hyd", "Berlin": "bln", "Hamburg": "hh", "Stockholm": "sthlm", "Lyon": "lyons", "Birmingham": "bham|brum", "Buffalo": "buf", "Rochester": "roc", "Tucson": "tus",
}
PLACE_WORDS = set("remote hybrid onsite near downtown greater area metro metropolitan city county district suburbs region surrounding in at of the north south east west central outside wfh home based location office hq headquarters and or inner".split())


def fold(text: str) -> str:
    """Lower case without accents; other characters than letters and digits part words."""
    t = text.translate({0x2019: "'", 0xAD: None, 0x200B: None}).casefold()
    if not t.isascii():
        t = "".join(ch for ch in unicodedata.normalize("NFKD", t.replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")) if not unicodedata.combining(ch))
    return " ".join(re.findall(r"[^\W_]+", t.replace("'", "")))


def deletions(word: str, k: int) -> set[str]:
    out = {word}
    edge = {word}
    for _ in range(k):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein, restricted: swaps and (un)doubled letters are cheap, a changed first letter is dear."""
    prev2: list[float] = []
    prev = [0.0]
    for j in range(1, len(b) + 1):
        prev.append(prev[-1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    for i in range(1, len(a) + 1):
        cur = [prev[0] + (0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0)]
        for j in range(1, len(b) + 1):
            sub = 0.0 if a[i - 1] == b[j - 1] else 1.3 if i == 1 or j == 1 else 1.0
            dele = 0.6 if i > 1 and a[i - 1] == a[i - 2] else 0.9 if i == len(a) and a[i - 1] == "s" else 1.0
            ins = 0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0
            v = min(prev[j - 1] + sub, prev[j] + dele, cur[j - 1] + ins)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, prev2[j - 2] + 0.7)
            cur.append(v)
        prev2, prev = prev, cur
    return prev[-1]


def allowed(n: int) -> int:
    """Edits allowed for a spelling of n letters."""
    return 0 if n <= 3 else 1 if n <= 5 else DISTANCE


class SymmetricDelete:
    """spelling -> payloads, found within `allowed` edits by deletions of both sides."""

    def __init__(self):
        self.exact: dict[str, set] = {}
        self.index: dict[str, set[str]] = {}
        self.fuzzy: set[str] = set()
        self.longest = 0

    def add(self, spelling: str, payload, fuzzy: bool = True) -> None:
        self.exact.setdefault(spelling, set()).add(payload)
        self.longest = max(self.longest, len(spelling))
        if fuzzy and spelling not in self.fuzzy:
            self.fuzzy.add(spelling)
            for d in deletions(spelling, allowed(len(spelling))):
                self.index.setdefault(d, set()).add(spelling)

    def find(self, text: str) -> list[tuple[float, object]]:
        """(weighted distance, payload) of all spellings near enough; exact ones alone if there are any."""
        if len(text) > self.longest + DISTANCE:
            return []  # too long for any
        if hit := self.exact.get(text):
            return [(0.0, p) for p in hit]
        k = min(DISTANCE, allowed(len(text) + 1))
        near = {s for d in deletions(text, k) for s in self.index.get(d, ()) if abs(len(s) - len(text)) <= k}
        out = []
        for s in near:
            w = weighted_distance(text, s)
            if w <= min(k, allowed(max(len(s), len(text)))) + 0.35 * (k > 1):
                out += [(w, p) for p in self.exact[s]]
        return out


_PHRASES = re.compile(r"\b(?:" + TITLE_PHRASES + r")\b")
_ADDITIONS = set(TITLE_WORDS.split())


class _Map:
    def resolve(self, value: str) -> int:
        hit = self.best(value)
        return hit[3] if hit else 0


class TitleMap(_Map):
    def __init__(self, entries: list[tuple[int, str]], frequency: dict[int, int]):
        self.frequency = frequency
        self.find = SymmetricDelete()
        self.labels = {label for _, label in entries}
        by_fold = {fold(label): ref for ref, label in entries}
        for ref, label in entries:
            words = fold(label).split()
            forms = {tuple(words)} | {tuple(words[i:] + words[:i]) for i in range(1, len(words))}
            for f in forms:
                self.find.add("".join(f), ref)
        for label, names in TITLE_ALIASES.items():
            if (ref := by_fold.get(fold(label))) is not None:
                for n in names.split("|"):
                    flat = n.replace(" ", "")
                    if flat not in self.find.exact:
                        self.find.add(flat, ref, fuzzy=len(flat) >= 7)

    def _readings(self, words: list[str], dropped: set[str]) -> set[tuple[str, bool]]:
        """(letters, whether an abbreviation is spelled out) of all ways to read the words that an entry is long enough for."""
        most = self.find.longest + DISTANCE
        states = {("", False)}
        for w in words:
            options = [(w, False)] + ([(o, True) for o in TITLE_SHORT[w].split("|")] if w in TITLE_SHORT else [])
            if w in dropped:
                options = [("", False)] + (options if w in TITLE_EITHER else [])
            states = {(t, short or more) for text, short in states for o, more in options if len(t := text + o.replace(" ", "")) <= most}
        return states - {("", False), ("", True)}

    def best(self, value: str) -> tuple | None:
        """(distance, 0, -frequency, entry) of the best hit."""
        text = _PHRASES.sub(" ", fold(value))
        words = [w for w in text.split() if not re.fullmatch(r"\d{3,}", w)]
        readings = self._readings(words, _ADDITIONS)
        if all(w in _ADDITIONS for w in words):
            readings |= self._readings(words, set())
        best = [(d + 0.05 * short, 0, -self.frequency.get(p, 0), p) for t, short in readings for d, p in self.find.find(t)]
        return min(best) if best else None


class PlaceMap(_Map):
    def __init__(self, entries: list[tuple[int, str, str, str, str]], frequency: dict[int, int]):
        self.frequency = frequency
        self.labels = {e[1] for e in entries}
        self.find = SymmetricDelete()
        self.context: dict[int, set[str]] = {}
        regions = SymmetricDelete()
        names: dict[str, set[str]] = {}

        def name(text: str, code: str):
            names.setdefault(text, set()).add(code)

        for code, spelled in COUNTRIES.items():
            for s in spelled.split("|"):
                name(s, f"country:{code}")
        us = {k for k in REGIONS if len(k) == 2}
        for code, spelled in REGIONS.items():
            for s in [fold(code), *spelled.split("|")]:
                name(s, f"region:{'US' if code in us else ''}:{fold(code)}")
        for ref, _, city, region, country in entries:
            flat = fold(city)
            self.find.add(flat.replace(" ", ""), (ref, flat))
            for a in CITY_ALIASES.get(city, "").split("|"):
                if a:
                    self.find.add(a.replace(" ", ""), (ref, flat), fuzzy=len(a) >= 7)
            r = f"region:{'US' if country == 'US' else ''}:{fold(region or '')}"
            name(fold(region or ""), r)
            name(fold(country or ""), f"country:{country}")
            self.context[ref] = {r, f"country:{country}"}
            if country == "GB":
                self.context[ref] |= {"region::england"} if fold(region or "") == "england" else set()
        self.names = {k: v for k, v in names.items() if k}
        for k in self.names:
            if len(k) >= 6:
                regions.add(k.replace(" ", ""), k)
        self.regions = regions
        self.longest = max((len(k.split()) for k in self.names), default=1)

    def _around(self, words: tuple[str, ...], ref: int) -> bool:
        """Whether the words around a city are names of its region or country, or additions."""
        i = 0
        while i < len(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                text = " ".join(words[i : i + n])
                codes = self.names.get(text)
                if codes is None and n * 6 <= len(text) + 5 and len(text) >= 6:
                    hits = [self.names[p] for d, p in self.regions.find(text.replace(" ", "")) if d <= 1.0]
                    codes = set().union(*hits) if hits else None
                if codes is not None:
                    if codes & self.context[ref]:
                        i += n
                        break
                    if text not in PLACE_WORDS:
                        return False
            else:
                if words[i] in PLACE_WORDS or words[i].isdigit():
                    i += 1
                else:
                    return False
        return True

    def best(self, value: str) -> tuple | None:
        """(distance, -words, -frequency, entry) of the best city whose surroundings fit it."""
        words = tuple(fold(value).split())
        most = self.find.longest + DISTANCE
        best = None
        for i in range(len(words)):
            j, text = i, ""
            while j < len(words) and len(text := text + words[j]) <= most:
                j += 1
                for d, (ref, city) in self.find.find(text):
                    if d > 0 and j - i > 1 and " " not in city:
                        continue  # a misspelt city of one word doesn't take in the word beside it
                    hit = (d, i - j, -self.frequency.get(ref, 0), ref)
                    if (best is None or hit < best) and self._around(words[:i] + words[j:], ref):
                        best = hit
        return best


def _mapper(blob, scores: bool):
    def run(batches):
        m = pickle.loads(blob.value)
        best = lru_cache(maxsize=300_000)(m.best)
        for batch in batches:
            values = batch.column("__value").to_pylist()
            keep = [i for i, n in enumerate(batch.schema.names) if scores or n != "__value"]
            if scores:
                hits = [best(v) or (None, None, None, None) for v in values]
                found = {n: pa.array([h[k] for h in hits], t) for k, (n, t) in enumerate((("d", pa.float64()), ("span", pa.int32()), ("rare", pa.int64()), ("ref", pa.int64())))}
            else:
                out = [None if v is None or v in m.labels else best(v) for v in values]
                found = {"ref_id": pa.array([h[3] if h else None if v is None or v in m.labels else 0 for h, v in zip(out, values)], pa.int64())}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *found.values()], names=[*[batch.schema.names[i] for i in keep], *found])

    return run


def map_values(df: DataFrame, column: str, canon: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """`keep` and ref_id: the entry that each value means, 0 for none; NULL for values that are blank or an entry to the letter.

    kind `title` reads canon (ref_id, label); `place` also city, region_code and country. One pass without a shuffle, so a
    value that a third of the rows share costs nothing. A list of more than BLOCK_ENTRIES entries is taken in blocks over
    the distinct values, and the best hit of all blocks counts. Values of any length are read; an empty list maps every
    value to 0.
    """
    spark = df.sparkSession
    cols = ["ref_id", "label"] + (["city", "region_code", "country"] if kind == "place" else [])
    listed = canon.where("ref_id IS NOT NULL AND label IS NOT NULL").select(*cols)
    blocks = max(1, -(-listed.count() // BLOCK_ENTRIES))
    block = F.pmod(F.xxhash64("ref_id"), F.lit(blocks))
    by_label = listed.select("ref_id", F.col("label").alias("__label"))
    named = df.select(F.col(column).alias("__label")).groupBy("__label").agg(F.count("*").alias("n")).join(by_label, "__label").groupBy("ref_id").agg(F.sum("n").alias("n"))
    if blocks > 1:
        named = cut(named)

    def dictionary(k: int):
        # a block has twice BLOCK_ENTRIES at most, but for chance beyond any reckoning
        entries = [tuple(r) for r in collect_bounded(listed.where(block == k), 2 * BLOCK_ENTRIES, "a block of the canonical list")]
        frequency = {r["ref_id"]: r["n"] for r in collect_bounded(named.where(block == k), 2 * BLOCK_ENTRIES, "a block of entries")}
        return spark.sparkContext.broadcast(pickle.dumps((TitleMap if kind == "title" else PlaceMap)(entries, frequency)))

    src = df.select(*keep, F.when(F.trim(F.regexp_replace(column, r"[\s\x{00A0}]+", " ")) != "", F.col(column)).alias("__value"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__value")
    if blocks == 1:
        return src.mapInArrow(_mapper(dictionary(0), False), f"{schema}, ref_id bigint")
    values = cut(src.select("__value").where("__value IS NOT NULL").distinct().join(by_label.select(F.col("__label").alias("__value")).distinct(), "__value", "left_anti"))
    hits = None
    for k in range(blocks):
        got = values.mapInArrow(_mapper(dictionary(k), True), "__value string, d double, span int, rare bigint, ref bigint")
        hits = got if hits is None else hits.unionByName(got)
    best = hits.groupBy("__value").agg(F.min(F.when(F.col("ref").isNotNull(), F.struct("d", "span", "rare", "ref"))).alias("m")).select("__value", F.coalesce("m.ref", F.lit(0)).alias("ref_id"))
    return src.join(best, "__value", "left").drop("__value")


def canonical_fields(jobs: DataFrame, canon_titles: DataFrame, canon_places: DataFrame) -> DataFrame:
    """(url, field_name, ref_id) of every typed title, title root and location that isn't an entry to the letter."""
    found = None
    for field, canon, kind in (("title", canon_titles, "title"), ("title_root", canon_titles, "title"), ("location", canon_places, "place")):
        got = map_values(jobs, field, canon, kind, ["url"]).where("ref_id IS NOT NULL").select("url", F.lit(field).alias("field_name"), "ref_id")
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def misses(jobs: DataFrame, canon_titles: DataFrame, canon_places: DataFrame) -> DataFrame:
    """(field_name, value, n): values that mean no entry, with the number of their urls."""
    got = canonical_fields(jobs, canon_titles, canon_places).where("ref_id = 0").select("url", "field_name")
    values = jobs.select("url", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("title", "title_root", "location"))), F.array("title", "title_root", "location"))).alias("field_name", "value")).distinct()
    return got.join(values, ["url", "field_name"]).where("value IS NOT NULL AND trim(value) <> ''").groupBy("field_name", "value").agg(F.countDistinct("url").alias("n"))
