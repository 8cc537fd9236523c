"""Personal data replaced by surrogates, with DataFrame functions only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: What personal data looks like (patterns of Java's regular expressions).
#: Repeated groups are bounded and inner loops possessive, so that no text makes the search deep or slow.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,63}"
IP = r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?![\w]|[.-]\d)|(?<![\w(+])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w]|[.-]\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.-])(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\w-])"
#: Titles by grammatical gender; the names behind them are personal data.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "n": ["Dr", "Prof"]}
PARTICLES = ["al", "bin", "da", "de", "del", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "y", "zu"]
#: A word of a name; a genitive 's is not part of it.
WORD = r"\p{Lu}\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++){0,8}"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
NAME = r"(?<![\p{L}\p{N}])(?:" + "|".join(t for g in TITLES.values() for t in g) + rf")\.? (?:{_PARTICLE} ){{0,3}}{WORD}(?: (?:{_PARTICLE} ){{0,3}}{WORD}){{0,3}}"
PERSONAL = "|".join((EMAIL, PHONE, SOCIAL, IP, CARD, NAME))
#: In texts with names, every capitalised word is looked at: it may be a later mention without title.
MENTION = PERSONAL + r"|(?<![\p{L}\p{N}_])" + WORD + r"(?![\w.%+-]*+@)"

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {"f": ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Ida", "Johanna", "Lena", "Marta", "Nora", "Olga", "Paula", "Rosa"], "m": ["Anton", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Leo", "Martin", "Oscar", "Paul", "Robert", "Viktor"]},
    "cyrillic": {"f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга"], "m": ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Макар", "Олег", "Павел"]},
    "greek": {"f": ["Άννα", "Δάφνη", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Ρένα", "Σοφία"], "m": ["Άρης", "Γιάννης", "Δήμος", "Ηλίας", "Κώστας", "Λευτέρης", "Νίκος", "Πέτρος"]},
}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "za", "zo"],
    "cyrillic": ["ба", "бе", "бо", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "ва", "ве", "во", "за", "зо"],
    "greek": ["βα", "βε", "βο", "δα", "δε", "δο", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε", "το", "φα", "φε", "φο", "ζα", "ζο"],
}
HOSTS = ["example.com", "example.net", "example.org"]
#: Endings of made-up given names by script and gender.
ENDINGS = {"latin": {"f": "ina", "m": "us", "n": "el"}, "cyrillic": {"f": "ина", "m": "ий", "n": "ель"}, "greek": {"f": "ίνα", "m": "ος", "n": "ης"}}
TYPES = ("email", "phone", "ssn", "ip", "card", "name")
#: A surrogate that is taken is derived anew. Names and local parts grow longer with each attempt; numbers
#: keep their length so many times and then get more digits, so that no form runs out.
SAME_LENGTH = 16
#: A word with a larger share of lower-case uses in all texts is a common word, also where it is a name.
COMMON = 0.2
#: Surrogates up to so many rows (some 100 bytes each) are broadcast; longer lists are joined by a shuffle.
BROADCAST_ENTITIES = 50_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def type_of(match: Column) -> Column:
    """Kind of a match; `word` is a capitalised word that may be a name."""
    return (
        F.when(F.contains(match, F.lit("@")), "email").when(match.rlike(r"^\p{L}") & F.contains(match, F.lit(" ")), "name").when(match.rlike(r"^\p{L}"), "word")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(match.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(match.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").otherwise("card")
    )


def canonical(kind: Column, match: Column) -> Column:
    """One form for all spellings of an address or number, so that all get the same surrogate."""
    return F.when(kind == "email", F.lower(match)).when(kind == "ip", match).otherwise(_digits(match))


def _gender(title: Column) -> Column:
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")


def _stream(key: Column, kind: Column, value: Column, attempt: Column) -> Column:
    """64 hexadecimal digits that the key, the entity and the attempt decide."""
    return F.sha2(F.concat_ws("\0", key, kind, value, attempt.cast("string"), key), 256)


def _number(stream: Column, at: int, below: int) -> Column:
    return (F.conv(F.substring(stream, 4 * at + 1, 4), 16, 10).cast("int") % below).cast("int")


def _luhn(digits: Column) -> Column:
    """Check sum, modulo 10, of a string of digits."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def _same_form(value: Column, stream: Column, letters: bool) -> Column:
    """The value with each digit (and ASCII letter) replaced by another from the stream."""
    hexes = F.concat(stream, stream, stream, stream)
    pick = lambda i, below: (F.conv(F.substring(hexes, i * 3 % 250 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")
    abc = F.lit("abcdefghijklmnopqrstuvwxyz")

    def other(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), pick(i, 10).cast("string"))
        return (out.when(c.rlike("[a-z]"), F.substring(abc, pick(i, 26) + 1, F.lit(1))) if letters else out).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def surrogate(key: Column, kind: Column, value: Column, attempt: Column) -> Column:
    """A replacement of the same type for a canonical value.

    Phone numbers keep their length and first digit, card numbers also the validity of their check
    digit, e-mail addresses the form of their local part. Where nearly all numbers of a form are in use
    the surrogate has more digits, written without the layout. Names come word by word, as
    role:gender:word with role g (given) or f (family), and keep role, gender and script."""
    stream = _stream(key, kind, value, attempt)
    changed = _same_form(value, stream, False)
    keep_first = F.concat(F.substring(value, 1, 1), F.substring(changed, F.lit(2), F.length(value)))
    extra = F.when(attempt >= SAME_LENGTH, F.substring(F.lpad(F.conv(F.substring(stream, 20, 15), 16, 10), 18, "0"), F.lit(1), attempt - (SAME_LENGTH - 1))).otherwise("")
    body = F.substring(keep_first, F.lit(1), F.length(value) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    card = F.when(_luhn(value) == 0, checked).otherwise(keep_first)
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    hosts = F.array(*map(F.lit, HOSTS))
    host_stream = _stream(key, F.lit("host"), host, F.lit(0))
    longer = F.when(attempt > 2, F.substring(F.conv(F.substring(stream, 40, 12), 16, 10), F.lit(1), attempt - 2)).otherwise("")
    email = F.concat(_same_form(local, stream, True), longer, F.lit("@mail"), _number(host_stream, 0, 10000).cast("string"), F.lit("."), F.get(hosts, _number(host_stream, 1, len(HOSTS))))
    ip = F.concat(F.concat_ws(".", *[(_number(stream, k, 254) + 1).cast("string") for k in range(4)]), F.when(attempt >= SAME_LENGTH, F.concat(F.lit("."), extra)).otherwise(""))
    role, gender, word = (F.get(F.split(value, ":"), k) for k in range(3))
    name = F.lit(None).cast("string")
    for script, letters in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        made = lambda count, s=syllables: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get(s, (F.conv(F.substring(stream, k * 3 % 60 + 2, F.lit(3)), 16, 10).cast("int") % 32).cast("int"))), "")
        of = lambda pick: F.when(gender == "f", pick("f")).when(gender == "m", pick("m")).otherwise(pick("n"))
        lists = {g: GIVEN[script]["f"] + GIVEN[script]["m"] if g == "n" else GIVEN[script][g] for g in "fmn"}
        listed = of(lambda g, x=lists: F.get(F.array(*map(F.lit, x[g])), _number(stream, 0, len(x[g]))))
        ending = of(lambda g, s=script: F.lit(ENDINGS[s][g]))
        given = F.when(attempt < 2, listed).otherwise(F.initcap(F.concat(made(F.lit(2) + (attempt / 3).cast("int")), ending)))
        family = F.initcap(made(F.lit(4) + (attempt / 3).cast("int")))
        name = F.coalesce(name, F.when(word.rlike(letters), F.when(role == "g", given).otherwise(family)))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "name", name).otherwise(F.concat(F.when(kind == "card", card).when(kind == "ssn", changed).otherwise(keep_first), extra))


def _render(kind: Column, match: Column, replacement: Column) -> Column:
    """The surrogate in the layout of this occurrence."""
    filled = F.aggregate(
        F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(replacement, s["used"] + 1, F.lit(1))).alias("out"), (s["used"] + 1).alias("used"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["used"].alias("used"))),
        lambda s: s["out"],
    )
    capitals = (match == F.upper(match)) & (F.length(match) > 1)
    plain = kind.isin("phone", "card", "ssn") & (F.length(replacement) == F.length(_digits(match)))
    return F.when(kind == "name", F.when(capitals, F.upper(replacement)).otherwise(replacement)).when(plain, filled).otherwise(replacement)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value): no two of a kind the same, and none that is
    itself a value found in the texts. What collides is derived again; as surrogates grow longer, this ends."""
    secret = F.lit(key)
    entities = checkpointed(entities)
    own = entities.select("kind", F.lower(F.when(F.col("kind") == "name", F.substring_index("value", ":", -1)).otherwise(F.col("value"))).alias("folded"))
    done, open_ = None, entities
    for attempt in count():
        tried = open_.withColumn("surrogate", surrogate(secret, F.col("kind"), F.col("value"), F.lit(attempt))).withColumn("folded", F.lower("surrogate"))
        taken = own if done is None else own.unionByName(done.select("kind", F.lower("surrogate").alias("folded")))
        known = tried.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "folded"], "left")
        placed = known.withColumn("place", F.row_number().over(Window.partitionBy("kind", "folded").orderBy("value")))
        placed = checkpointed(placed.select("kind", "value", "surrogate", (F.col("taken").isNull() & (F.col("place") == 1)).alias("free")))
        now = placed.filter("free").select("kind", "value", "surrogate")
        done = now if done is None else done.unionByName(now)
        open_ = placed.filter("not free").select("kind", "value")
        if open_.isEmpty():
            return done


def _name_words(parts: DataFrame) -> DataFrame:
    """For the words of titled names (digest, title, word, role): digest, word and value, where value
    says role, gender and word. A given name has the gender of most of its titles in all texts."""
    votes = parts.filter("role = 'g'").groupBy("word").agg(F.sum((F.col("gender") == "f").cast("int")).alias("f"), F.sum((F.col("gender") == "m").cast("int")).alias("m"))
    settled = votes.select("word", F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n").alias("settled"))
    known = parts.groupBy("digest", "word").agg(F.max("role").alias("role"))  # a word that is both counts as a given name
    joined = known.join(settled, "word", "left")
    return joined.select("digest", "word", F.concat_ws(":", "role", F.when(F.col("role") == "g", F.col("settled")).otherwise("n"), "word").alias("value"))


def _common_words(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked words (lower case), those that all texts use in lower case more often than COMMON."""
    used = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}++"), F.lit(0))).alias("form")).withColumn("word", F.lower("form"))
    lower = F.sum((F.col("form") == F.col("word")).cast("long"))
    counted = used.join(asked, "word").groupBy("word").agg(lower.alias("lower"), F.count("*").alias("uses"))
    return counted.filter(F.col("lower") > COMMON * F.col("uses")).select("word")


def _mentions(single: DataFrame, parts: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of the names of each text, as _name_words gives them, and the places of lone capitalised
    words (digest, place) that mention one.

    A capitalised word right before a known family name is taken for a given name of that person,
    unless it is a common word. A lone word that equals a word of a name mentions it if it is not a
    common word, or stands beside another word of a name; so in a text with Dr Will May, `Will May` is
    replaced, and `Will it rain in May` is not."""
    order = Window.partitionBy("digest").orderBy("place")
    seen = single.select("digest", "place", "kind", "gap", F.lower("match").alias("word"))
    seen = seen.withColumns({"before": F.when((F.lag("kind").over(order) == "word") & (F.col("gap") == " "), F.lag("word").over(order)), "after": F.when((F.lead("kind").over(order) == "word") & (F.lead("gap").over(order) == " "), F.lead("word").over(order))})
    lone = checkpointed(seen.filter("kind = 'word'").drop("kind", "gap"))
    known = parts.select("digest", "word").distinct()
    family = parts.filter("role = 'f'").select("digest", F.col("word").alias("after")).distinct()
    titles = [t.lower() for g in TITLES.values() for t in g]
    given = lone.filter(~F.col("word").isin(titles)).join(family, ["digest", "after"]).join(known, ["digest", "word"], "left_anti").select("digest", "word").distinct()
    asked = checkpointed(known.select("word").unionByName(given.select("word")).distinct())
    common = checkpointed(_common_words(texts, asked)) if not asked.isEmpty() else asked
    untitled = given.join(common, "word", "left_anti").select("digest", "word", F.lit("n").alias("gender"), F.lit("g").alias("role"))
    words = checkpointed(_name_words(parts.unionByName(untitled)))
    named = words.select("digest", "word")
    beside = [lone.join(named.withColumnRenamed("word", c), ["digest", c]).select("digest", "place") for c in ("before", "after")]
    own = lone.join(named, ["digest", "word"])
    told = own.join(common, "word", "left_anti").select("digest", "place")
    return words, told.unionByName(own.select("digest", "place").join(beside[0].unionByName(beside[1]), ["digest", "place"], "left_semi")).distinct()


def replace_personal(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data in every whole text: doc_id, text, n_entities, and found, an array of
    (kind, surrogate) in the order of the text.

    Found are e-mail addresses, telephone, social security, card and IP numbers, names behind a title
    (with particles), and in the same text their other mentions, by the rules of _mentions.
    Every spelling of an address or number gets the same surrogate in all documents, and names are
    replaced word by word: John Smith, Dr Smith, Mr John Smith and Smith stay one person, and a given
    name has one gender. Words keep role, script and capitals, titles and particles stay. Different
    entities get different surrogates, none of which occurs in the texts as an entity. The same key
    and table give the same surrogates; other tables may collide, and be resolved, otherwise.

    Only matches are shuffled, and texts that have any; texts are told apart by their digest, so rows
    that repeat share the work and a hot text counts once. Null texts stay null and empty ones empty.
    One row per input row; other columns are ignored; an empty table gives no rows. No text makes the
    patterns recurse deeply: repeated groups are bounded (an address has 126 labels at most).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Every kind has a digit, an @ or a title; plain searches for these spare most texts the patterns.
    may = F.col("text").rlike("[0-9@]")
    for title in (t for g in TITLES.values() for t in g):
        may |= F.contains("text", F.lit(title))
    rows = rows.withColumn("matches", F.when(may, F.regexp_extract_all("text", F.lit(PERSONAL), F.lit(0))))
    without = rows.filter("matches is null or size(matches) = 0").select("doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<struct<kind:string,surrogate:string>>").alias("found"))
    named = F.exists("matches", lambda m: type_of(m) == "name")
    having = rows.filter("size(matches) > 0").withColumn("named", named).withColumn("digest", F.sha2("text", 256))
    having = having.withColumn("matches", F.when(F.col("named"), F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).otherwise(F.col("matches")))
    # With each match the last characters before it; they say whether two words stand side by side.
    gaps = F.slice(F.when(F.col("named"), F.split("text", MENTION, -1)).otherwise(F.array()), F.lit(1), F.size("matches"))
    paired = F.zip_with("matches", gaps, lambda m, gap: F.struct(m.alias("match"), F.coalesce(F.right(gap, F.lit(3)), F.lit("")).alias("gap")))
    texts = having.select("digest", paired.alias("matches")).groupBy("digest").agg(F.first("matches").alias("matches"))
    single = checkpointed(texts.select("digest", F.posexplode("matches").alias("place", "m")).select("digest", "place", "m.*").withColumn("kind", type_of(F.col("match"))))

    # Names: the words behind the title, the last of which is the family name.
    is_name = F.col("kind").isin("name", "word")
    pieces = single.filter(is_name).select("digest", "place", "kind", F.posexplode(F.split("match", " ")).alias("at", "piece"), F.size(F.split("match", " ")).alias("n"))
    pieces = pieces.withColumn("word", F.when(((F.col("kind") == "word") | (F.col("at") > 0)) & ~F.col("piece").isin(PARTICLES), F.lower("piece")))
    title = single.filter("kind = 'name'").select("digest", "place", F.regexp_extract("match", r"^\p{L}+", 0).alias("title"))
    parts = pieces.filter("kind = 'name' and word is not null").join(title, ["digest", "place"])
    parts = parts.select("digest", "word", _gender(F.col("title")).alias("gender"), F.when(F.col("at") == F.col("n") - 1, "f").otherwise("g").alias("role"))
    words, mentioned = _mentions(single, checkpointed(parts), rows.select("text"))
    pieces = pieces.join(mentioned.withColumn("mentions", F.lit(True)), ["digest", "place"], "left")
    pieces = pieces.withColumn("word", F.when((F.col("kind") == "name") | F.col("mentions"), F.col("word"))).drop("mentions")
    plain = single.filter(~is_name).withColumn("value", canonical(F.col("kind"), F.col("match")))

    # One surrogate for each value, then back to its places.
    chosen = checkpointed(assign_surrogates(plain.select("kind", "value").unionByName(words.select(F.lit("name").alias("kind"), "value")).distinct(), key))
    few = chosen.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    chosen = F.broadcast(chosen) if few else chosen  # else a shuffle, whose hot values the adaptive skew join splits
    numbers = plain.join(chosen, ["kind", "value"]).select("digest", "place", "kind", _render(F.col("kind"), F.col("match"), F.col("surrogate")).alias("surrogate"))
    of_word = words.withColumn("kind", F.lit("name")).join(chosen, ["kind", "value"]).select("digest", "word", "surrogate")
    spoken = pieces.join(of_word, ["digest", "word"], "left").withColumn("piece_out", F.coalesce(_render(F.lit("name"), F.col("piece"), F.col("surrogate")), F.col("piece")))
    people = spoken.groupBy("digest", "place", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece_out"))), lambda s: s["piece_out"]), " ").alias("surrogate"), F.bool_or(F.col("surrogate").isNotNull()).alias("hit"))
    people = people.select("digest", "place", F.when(F.col("hit"), "name").otherwise("word").alias("kind"), "surrogate")
    placed = numbers.unionByName(people).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "surrogate"))).alias("fills"))
    gaps = F.when(F.col("named"), F.split("text", MENTION, -1)).otherwise(F.split("text", PERSONAL, -1))
    text = F.array_join(F.flatten(F.zip_with(gaps, "fills", lambda gap, s: F.array(gap, F.coalesce(s["surrogate"], F.lit(""))))), "")
    found = F.transform(F.filter("fills", lambda s: s["kind"] != "word"), lambda s: F.struct(s["kind"].alias("kind"), s["surrogate"].alias("surrogate")))
    replaced = having.select("doc_id", "text", "digest", "named").join(placed, "digest").select("doc_id", text.alias("text"), F.size(found).alias("n_entities"), found.alias("found"))
    return without.unionByName(replaced)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal(table(spark, sf_dir, "documents"), key="op10")
