"""Resolution of names to scopes, and the text a query is searched with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, normalised, scope_key

#: Longest alias in words; a query's word runs up to this length meet aliases by an equi-join.
ALIAS_WORDS = 6

# What a field's words prepend to a search text, in order; the first that is found counts.
FIELD_TERMS = (
    (r"declared distance|\btora\b|\btoda\b|\basda\b|\blda\b", "AD 2.13 declared distances TORA TODA ASDA LDA"),
    (r"\batis\b|\btwr\b|\btower\b|ground control|clearance delivery|approach control|communication frequenc|\bcomm\b|callsign", "AD 2.18 ATS communication facilities ATIS TWR APP GND frequency MHz callsign"),
    (r"\btaf\b|\bmetar\b|\btrend\b|meteorolog|weather (report|forecast)|forecast validity|met office", "AD 2.11 meteorological information TAF METAR TREND period of validity forecast"),
    (r"\bvor\b|\bdme\b|\bndb\b|navaid|identifier|\bident\b", "AD 2.19 radio navigation landing aids VOR DME identifier frequency MHz"),
    (r"\bils\b|localizer|localiser|glide ?path", "AD 2.19 ILS localizer glide path category frequency MHz"),
    (r"transition (altitude|level)", "transition altitude transition level flight level QNH AMSL feet metres AD 2.17"),
    (r"elevation|how high|\bamsl\b|reference temperature|temperature", "AD 2.2 aerodrome elevation reference temperature feet metres AMSL"),
    (r"taxiway|\btwy\b", "AD 2.14 taxiway width surface"),
    (r"\bfire\b|rescue|\brffs\b|fire ?fighting|fire category", "AD 2.6 rescue and fire fighting RFFS category"),
    (r"\bfuel\b|jet ?a|avgas|oil type", "AD 2.6 fuel oil types available"),
    (r"\bpcn\b|\bpcr\b|pavement|strength", "AD 2.12 PCN PCR pavement classification strength"),
    (r"dimension|length|width|surface|\brunway\b", "AD 2.12 runway physical characteristics length width surface bearing PCN"),
)
AIRSPACE_TERMS = "CTR TMA FIR UIR control zone terminal control area lateral limits vertical limits airspace radius NM centred"

# The section that a question's distinctive terms belong to, in order.
FLIGHT_PROCEDURES = r"(?i)\b(flight\s+procedures?|holding\s+procedure|letdown|let-?down|missed\s+approach|circling|approach\s+minima|take-?off\s+minima|oca\b|och\b|pbn\b|rnp\s+ar)\b"
SECTION_TERMS = (
    ("AD 2.16", r"(?i)\b(tlof|fato|helicopter\s+landing|helipad|helideck)\b"),
    ("AD 2.11", r"(?i)\b(met\s+office|meteorolog\w+|taf\b|trend\s+forecast|landing\s+forecast|flight\s+documentation|met\s+briefing|awos|llwas)\b"),
    ("AD 2.8", r"(?i)\b(altimeter\s+check\w*|vor\s+check\w*|ins\s+check\w*|checkpoint)\b|\b(apron|taxiway|twy)\b.{0,25}\b(surface|strength|width|designation|pcn)\b|\b(surface|strength|width)\b.{0,25}\b(apron|taxiway|twy)\b"),
    ("AD 2.9", r"(?i)\b(stop\s?bars?|stand\s+id\s+signs?|taxi\s*-?\s*link|guide\s+lines?|docking\s+guidance|surface\s+movement\s+guidance)\b|\b(taxiway|twy|runway|rwy)\s+markings?\b"),
    ("AD 2.15", r"(?i)\b(abn|ibn|aerodrome\s+beacon|identification\s+beacon|wind\s+direction\s+indicator|wdi|anemometer|secondary\s+power|standby\s+power|switch-?over|apron\s+flood\w*)\b"),
    ("AD 2.6", r"(?i)\b(rff|rescue\s+and\s+fire|fire\s+fighting|fire\s+category|crash\s+rescue|disabled\s+aircraft)\b"),
    ("AD 2.4", r"(?i)\b(fuel(?:ling|ing)?|jet\s*a-?1|avgas|oil\s+type|hangar|cargo[\s-]*handling|repair\s+facilit\w+|de-?icing|ground\s+handling)\b"),
    ("AD 2.5", r"(?i)\b(hotels?|restaurants?|passenger\s+facilit\w+|tourist|medical\s+facilit\w+|bank\b|post\s+office|transportation)\b"),
    ("AD 2.10", r"(?i)\b(obstacles?|obstruction\w*)\b"),
    ("AD 2.17", r"(?i)\b(ctr\b|tma\b|control\s+zone|terminal\s+(?:control\s+)?area|airspace\s+class\w*|transition\s+(?:altitude|level)|vertical\s+limits?|lateral\s+limits?|ats\s+airspace)\b"),
    ("AD 2.20", r"(?i)\b(local\s+(?:aerodrome\s+)?regulations?|airport\s+regulations?|taxiing\s+limitation\w*|school\s+(?:and\s+)?training\s+flights?|parking\s+area|fuel\s+spillage)\b"),
    ("AD 2.21", r"(?i)\b(noise\s+abatement|noise\s+preferent\w+|noise\s+restrict\w+)\b"),
    ("AD 2.23", r"(?i)\b(bird\s+\w*|birds\b|wildlife|animal\s+hazard|animals?\s+on\s+(?:the\s+)?runway)\b"),
    ("AD 2.7", r"(?i)\b(seasonal\s+availab\w+|clearing\s+equipment|snow\s+plan|clearance\s+priorit\w+)\b"),
    ("AD 2.3", r"(?i)\b(operational\s+hours?|hours\s+of\s+operation|opening\s+hours?|customs|immigration|health\s+and\s+sanitation|ats\s+reporting|\baro\b|ais\s+briefing)\b"),
    ("AD 2.2", r"(?i)\b(arp\b|aerodrome\s+reference\s+point|magnetic\s+variation|mag\s*var|reference\s+temperature|aftn|geoid\s+undulation|aerodrome\s+(?:administration|operator))\b"),
)
# Fixed value: what asks for a place in the publication.
STRUCTURE_QUESTION = r"(?i)\bwhich\s+(part|section|chapter)\b|\bwhat\s+(part|section|chapter)\b|\b(part|section|chapter)\s+of\s+the\s+aip\b|\bwhere\s+in\s+the\s+aip\b|\bwhere\s+(would|do|can|could|should)\s+i\s+find\b"


#: Rows of names up to which they are broadcast, so that questions that name the same do not meet in one task.
MOST_NAMES = 100_000


def few(names: DataFrame) -> DataFrame:
    """Names that questions look up: broadcast if they are few, else joined by a shuffle."""
    return F.broadcast(names) if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES else names


def word_runs(df: DataFrame, id_column: str, text: str, longest: int = ALIAS_WORDS) -> DataFrame:
    """id, run, n_words: every run of up to `longest` words of the normalised text, once for each row."""
    words = F.filter(F.split(normalised(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    w = df.select(id_column, words.alias("w")).where("size(w) > 0")
    starts = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.struct(F.array_join(F.slice("w", i, n), " ").alias("run"), n.alias("n_words"))))
    return w.select(id_column, F.explode(F.array_distinct(F.flatten(starts))).alias("r")).select(id_column, "r.run", "r.n_words")


def resolve_aliases(queries: DataFrame, aliases: DataFrame, longest: int = ALIAS_WORDS) -> DataFrame:
    """query_id, scopes (sorted), n: the ids of the longest alias that stands in the name as whole words. Longer aliases
    than `longest` words are matched by containment, which only they need."""
    a = aliases.select(F.col("scope_id"), normalised(F.col("alias")).alias("run")).where("run <> ''").distinct()
    size = F.size(F.split("run", " "))
    short = word_runs(queries, "query_id", "name", longest).join(few(a.where(size <= longest)), "run").select("query_id", "run", "scope_id")
    rare = a.where(size > longest).withColumn("head", F.array_join(F.slice(F.split("run", " "), 1, longest), " "))
    named = queries.select("query_id", normalised(F.col("name")).alias("n"))
    heads = word_runs(queries, "query_id", "name", longest).where(F.col("n_words") == longest).select("query_id", F.col("run").alias("head"))
    far = heads.join(few(rare), "head").join(named, "query_id").where(F.contains(F.concat(F.lit(" "), "n", F.lit(" ")), F.concat(F.lit(" "), "run", F.lit(" ")))).select("query_id", "run", "scope_id")
    hits = short.unionByName(far)
    top = F.max(F.length("run")).over(Window.partitionBy("query_id"))
    best = hits.withColumn("top", top).where(F.length("run") == F.col("top")).groupBy("query_id").agg(F.array_sort(F.collect_set("scope_id")).alias("scopes"))
    empty = F.expr("cast(array() as array<string>)")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("scopes", empty).alias("scopes"), F.size(F.coalesce("scopes", empty)).alias("n"))


def published_entities(sources: list[tuple[str, DataFrame]], airspaces: DataFrame | None = None) -> DataFrame:
    """token, scope_kind, scope_id: names that are published, one scope for each, the first source winning. Airspaces
    (scope_id) are known by 'CITY KIND' and 'CITYKIND' too."""
    every = None
    for i, (kind, df) in enumerate(sources):
        one = df.select(scope_key(F.col("scope_id")).alias("token"), F.lit(kind).alias("scope_kind"), "scope_id", F.lit(i).alias("p"))
        every = one if every is None else every.unionByName(one)
    if airspaces is not None:
        city = F.upper(F.regexp_extract("scope_id", r"^([A-Za-z' ]+?)\s+(?:Flight|Terminal|Control|FIR|UIR|TMA|CTA|SECTOR)", 1))
        kind = F.coalesce(*[F.when(F.upper("scope_id").rlike(p), F.lit(k)) for p, k in ((r"TERMINAL|\bTMA\b", "TMA"), (r"INFORMATION|\bFIR\b", "FIR"), (r"CONTROL AREA|\bCTA\b", "CTA"))])
        a = airspaces.select("scope_id", city.alias("c"), kind.alias("k")).where("c <> '' and k is not null")
        names = a.select(F.explode(F.array(F.concat_ws(" ", "c", "k"), F.concat("c", "k"))).alias("t"), "scope_id")
        more = names.select(scope_key(F.col("t")).alias("token"), F.lit("ENR_AIRSPACE").alias("scope_kind"), "scope_id", F.lit(len(sources)).alias("p"))
        every = every.unionByName(more)
    first = F.min_by(F.struct("scope_kind", "scope_id"), F.struct("p", "scope_id"))
    return every.groupBy("token").agg(first.alias("s")).select("token", "s.scope_kind", "s.scope_id")


def spot_entities(queries: DataFrame, published: DataFrame, valid_ids: DataFrame) -> DataFrame:
    """query_id, token of queries(query_id, raw) without a subject: a prefixed route token if it is published, else the
    first word that is (and is no id), else an area id."""
    prefixed = F.transform(F.regexp_extract_all("raw", F.lit(r"\b([A-Za-z]/U?[A-Za-z]\d{1,3}[A-Za-z]?)\b"), F.lit(1)), F.upper)
    words = F.transform(F.regexp_extract_all("raw", F.lit(r"\b([A-Za-z][A-Za-z0-9]{1,5})\b"), F.lit(1)), F.upper)
    tag = lambda arr, k: F.transform(arr, lambda t, i: F.struct(F.lit(k).alias("k"), i.alias("i"), t.alias("token")))
    t = queries.select("query_id", F.explode(F.concat(tag(prefixed, 0), tag(words, 1))).alias("t")).select("query_id", "t.*")
    hit = t.join(published.select("token").distinct(), "token", "left_semi").join(valid_ids.select(F.upper("scope_id").alias("token")), "token", "left_anti")
    first = hit.groupBy("query_id").agg(F.min_by("token", F.struct("k", "i")).alias("token"))
    area = F.regexp_replace(F.regexp_extract(F.upper("raw"), r"\b(DN[PRD]\s?\d{1,3})\b", 1), r"\s+", "")
    return queries.select("query_id", area.alias("area")).join(first, "query_id", "left").select("query_id", F.coalesce("token", F.nullif("area", F.lit(""))).alias("token"))


def resolve_scope(queries: DataFrame, aliases: DataFrame, published: DataFrame, valid_ids: DataFrame, out_of_scope: DataFrame, fir: str = "DNKK", code: str = r"^DN[A-Z]{2}$", field_intents: tuple[str, ...] = ("aerodrome_fact", "icao_lookup", "runway_data", "chart_retrieval", "procedure_lookup")) -> DataFrame:
    """query_id, status (scope, national, ambiguous, out_of_scope, invalid, unresolved), scope_kind, scope_id, part,
    reference, candidates of queries(query_id, intent, code, name, preferred_part), by a fixed order of rules."""
    known = published.select("token", F.col("scope_kind").alias("e_kind"), F.col("scope_id").alias("e_id"))
    name, c = blank_to_null(F.col("name")), F.upper(F.coalesce(F.trim("code"), F.lit("")))
    q = queries.withColumns({"name": name, "code": c, "token": scope_key(name)})
    hit = resolve_aliases(q.where("name is not null"), aliases)
    lost = out_of_scope.select(F.col("scope_id").alias("o_id"), F.split(normalised(F.col("place")), " ")[0].alias("o_word"))
    words = q.select("query_id", F.explode(F.split(normalised(F.coalesce("name", F.lit(""))), " ")).alias("o_word"))
    gone = words.join(few(lost), "o_word").groupBy("query_id").agg(F.min("o_id").alias("o_id"))
    q = (
        q.join(few(known), "token", "left")
        .join(hit, "query_id", "left")
        .join(gone, "query_id", "left")
        .join(few(valid_ids.select(F.upper("scope_id").alias("code"), F.lit(True).alias("is_valid"))), "code", "left")
        .join(few(out_of_scope.select(F.upper("scope_id").alias("code"), F.lit(True).alias("is_lost"))), "code", "left")
        .join(few(valid_ids.select(scope_key(F.col("ident")).alias("token"), F.lit(True).alias("is_ident")).where("token is not null").distinct()) if "ident" in valid_ids.columns else q.select("token", F.lit(True).alias("is_ident")).limit(0), "token", "left")
    )
    none, n = F.lit(None).cast("string"), F.coalesce("n", F.lit(0))

    def row(status: str, kind: Column = none, sid: Column = none, part: Column = none, reference: Column = none, candidates: Column | None = None) -> Column:
        cand = F.expr("cast(array() as array<string>)") if candidates is None else candidates
        return F.struct(F.lit(status).alias("status"), kind.alias("scope_kind"), sid.alias("scope_id"), part.alias("part"), reference.alias("reference"), cand.alias("candidates"))

    lit, ad, enr, gen = F.lit, F.lit("AD"), F.lit("ENR"), F.lit("GEN")
    is_code, named, entity = F.col("code").rlike(code), F.col("name").isNotNull(), F.col("e_id").isNotNull()
    route_words = F.lower("name").rlike(r"fir|en-?route")
    chosen = (
        F.when((F.col("intent") == "airspace_lookup") & entity & (F.col("e_kind") == "ENR_AIRSPACE"), row("scope", F.col("e_kind"), F.col("e_id"), enr, lit("AIRSPACE")))
        .when(F.col("intent") == "airspace_lookup", row("national", none, none, enr, lit("AIRSPACE")))
        .when(F.col("intent") == "national_lookup", row("national", none, none, gen, lit("NATIONAL")))
        .when(is_code & F.col("is_valid"), row("scope", ad, F.col("code"), ad, F.col("code")))
        .when(is_code & (F.col("code") == fir), row("national", none, none, enr, lit(fir)))
        .when(is_code & F.col("is_lost"), row("out_of_scope", none, F.col("code")))
        .when(is_code, row("invalid", none, F.col("code")))
        .when(named & route_words, row("national", none, none, enr, lit("AIRSPACE")))
        .when(named & F.col("is_ident") & (F.col("e_kind") == "ENR_NAVAID"), row("ambiguous", F.lit("scope"), candidates=F.concat(F.col("scopes"), F.array("e_id"))))
        .when(named & (n == 1), row("scope", ad, F.get(F.col("scopes"), F.lit(0)), ad, F.get(F.col("scopes"), F.lit(0))))
        .when(named & (n > 1), row("ambiguous", F.lit("aerodrome"), candidates=F.col("scopes")))
        .when(named & F.col("o_id").isNotNull(), row("out_of_scope", none, F.col("o_id")))
        .when(named & entity, row("scope", F.col("e_kind"), F.col("e_id"), enr, lit("AIRSPACE")))
        .when(named, row("unresolved"))
        .when(F.col("intent").isin(*field_intents), row("unresolved"))
        .otherwise(row("national", none, none, F.when(F.col("preferred_part").isin("GEN", "ENR"), F.col("preferred_part")).otherwise("GEN")))
    )
    return q.select("query_id", chosen.alias("r")).select("query_id", "r.*")


def build_search_text(hint: Column, intent: Column, part: Column, raw: Column) -> Column:
    """Place, then airspace terms or the terms of the first field that is named, then the question."""
    field = F.coalesce(*[F.when(raw.rlike(f"(?i){p}"), F.lit(t)) for p, t in FIELD_TERMS])
    terms = F.when(intent == "airspace_lookup", F.lit(AIRSPACE_TERMS)).when(part == "AD", field)
    return F.trim(F.concat_ws(" ", blank_to_null(hint), terms, blank_to_null(raw)))


def detect_subsection(question: Column) -> Column:
    """The section a question's terms belong to; flight procedures first; null without a distinctive term."""
    return F.coalesce(F.when(question.rlike(FLIGHT_PROCEDURES), F.lit("AD 2.22")), *[F.when(question.rlike(p), F.lit(s)) for s, p in SECTION_TERMS])


def toc_lookup(questions: DataFrame, toc: DataFrame) -> DataFrame:
    """questions with reference and title of the first toc entry (rank, keyword, reference, title) whose keyword they
    hold; null if they do not ask for structure. Questions meet keywords by an equi-join over the keywords' first three
    characters, however many there are, and containment decides. Equal questions are looked up once."""
    keys = toc.select(F.col("keyword").alias("key"), F.struct("rank", "keyword", "reference", "title").alias("entry")).where("key <> ''")
    keys = keys.withColumn("gram", F.substring("key", 1, 3))
    low = F.concat(F.lit(" "), F.lower("question"), F.lit(" "))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))))
    asked = questions.select("question").where(F.col("question").rlike(STRUCTURE_QUESTION)).distinct()
    hits = asked.select("question", F.explode(F.array_distinct(grams)).alias("gram")).join(keys, "gram").where(F.contains(low, F.col("key")))
    first = hits.groupBy("question").agg(F.min("entry").alias("_t"))
    return questions.join(first, "question", "left").withColumns({"reference": F.col("_t.reference"), "title": F.col("_t.title")}).drop("_t")
