"""Column expressions for titles, prices, conditions and dates; no Python on the data path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the n-gram tokenizer (fixed values).
NGRAM_STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "for", "in", "on", "at", "to",
    "is", "it", "by", "as", "be", "no", "not", "so", "up", "if", "my",
    "this", "that", "from", "was", "are", "has",
)
#: Stop words of the TF-IDF tokenizer (fixed values).
TFIDF_STOP_WORDS = (
    "free", "shipping", "postage", "delivery", "fast", "tracked", "dispatch", "express", "royal", "mail",
    "new", "brand", "sealed", "mint", "condition", "genuine", "official", "authentic", "factory",
    "the", "a", "an", "and", "or", "of", "for", "with", "in", "on", "to", "from", "by", "at", "is", "it", "this", "that",
)
#: Words that keep their final s (fixed values).
SINGULAR_EXCEPTIONS = ("series", "lens", "species", "canvas", "alias", "bonus", "campus", "corpus", "ibus", "atlas", "plus", "minus")
#: Endings that make two words variants of a stem (fixed values).
STEM_SUFFIXES = ("ed", "d", "ing", "er", "est", "ic", "s")
#: Currency symbols (fixed values).
CURRENCIES = {"£": "GBP", "GBP": "GBP", "$": "USD", "US $": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "C $": "CAD", "CAD": "CAD"}
#: Condition texts of search pages, tried in this order (fixed values); item pages also know New and Used.
CONDITIONS = {
    "Brand new": "NEW",
    "Pre-owned": "USED",
    "Opened – never used": "OPENED_NEVER_USED",
    "Parts only": "FOR_PARTS_NOT_WORKING",
    "Excellent - Refurbished": "EXCELLENT_REFURBISHED",
    "Very Good - Refurbished": "VERY_GOOD_REFURBISHED",
    "Good - Refurbished": "GOOD_REFURBISHED",
}
ITEM_CONDITIONS = {"Brand new": "NEW", "New": "NEW", "Pre-owned": "USED", "Used": "USED"} | CONDITIONS


def _words(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of more than one character, Unicode letters included."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: F.length(w) > 1))


def singular(w: Column) -> Column:
    """Ordered rules for English plurals."""
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    n = F.length(w)
    return (
        F.when((n <= 3) | F.lower(w).isin(*SINGULAR_EXCEPTIONS), w)
        .when(F.endswith(w, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when((F.endswith(w, F.lit("lves")) | F.endswith(w, F.lit("aves"))) & (n > 5), F.concat(cut(3), F.lit("f")))
        .when(F.endswith(w, F.lit("ses")) & (n > 4), cut(1))
        .when(F.endswith(w, F.lit("ss")) | F.endswith(w, F.lit("us")), w)
        .when(F.endswith(w, F.lit("s")), cut(1))
        .otherwise(w)
    )


def ngram_tokens(title: Column, drop: Column | None = None) -> Column:
    """Words in order without stop words, in the singular, without the search tokens."""
    w = F.regexp_extract_all(F.lower(title), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    w = F.transform(F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*NGRAM_STOP_WORDS)), singular)
    return w if drop is None else F.filter(w, lambda x: ~F.array_contains(drop, x))


def tfidf_tokens(text: Column) -> Column:
    """Runs of letters and digits of more than one character, without stop words."""
    w = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", " "), " +")
    return F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*TFIDF_STOP_WORDS))


def ngrams(words: Column, longest: int = 3) -> Column:
    """All n-grams up to `longest` words, joined by blanks."""
    one = lambda n: F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(*(one(n) for n in range(1, longest + 1)))


def pattern_matches(ngram: Column, title: Column) -> Column:
    """Several words match as a substring, one word between characters that are no letters or digits."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]", " "), F.lit(" "))
    return F.when(F.contains(ngram, F.lit(" ")), F.contains(F.lower(title), ngram)).otherwise(F.contains(padded, F.concat(F.lit(" "), ngram, F.lit(" "))))


def word_matches(ngram: Column, title: Column) -> Column:
    """The variant with regex word boundaries, for which underscores belong to words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(title), r"(?U)\W", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), ngram, F.lit(" ")))


def stem_variants(a: Column, b: Column) -> Column:
    """Both of three characters or more: one is the other plus a suffix, or they differ in one character."""
    a, b = F.lower(a), F.lower(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    suffixed = F.startswith(long, short) & F.substring(long, F.length(short) + 1, F.length(long)).isin(*STEM_SUFFIXES)
    diffs = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return (F.length(short) >= 3) & (suffixed | ((F.length(a) == F.length(b)) & (diffs == 1)))


def numeric_variants(a: Column, b: Column) -> Column:
    """Equal but for their numbers."""
    form, digits = (lambda x: F.regexp_replace(x, r"\d+", "#")), (lambda x: F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)))
    return (form(a) == form(b)) & F.contains(form(a), F.lit("#")) & (digits(a) != digits(b))


def resolved_substring(values: Column) -> Column:
    """The one value that contains all others, else null."""
    return F.try_element_at(F.filter(values, lambda v: F.forall(values, lambda o: F.contains(v, o))), F.lit(1))


def embed_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(description), F.lit("")))


def iso_currency(symbol: Column) -> Column:
    """ISO code of a symbol; unknown ones stay, blank is null."""
    s = F.nullif(F.trim(symbol), F.lit(""))
    return F.coalesce(reduce(lambda c, kv: c.when(F.upper(s) == kv[0], kv[1]), CURRENCIES.items(), F.when(F.lit(False), "")), s)


def card_price(text: Column) -> Column:
    """Price of a search card: a single comma without a point is a decimal comma; 0 if nothing parses."""
    kept = F.regexp_replace(text, r"[^0-9.,]", "")
    commas = F.length(kept) - F.length(F.replace(kept, F.lit(",")))
    kept = F.when((commas == 1) & ~F.contains(kept, F.lit(".")), F.replace(kept, F.lit(","), F.lit("."))).otherwise(kept)
    return F.coalesce(F.replace(kept, F.lit(",")).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("double")


def item_price(text: Column) -> Column:
    """First numeric run of an item page's price, else null."""
    return F.replace(F.regexp_extract(text, r"[0-9][0-9.,]*", 0), F.lit(",")).try_cast("decimal(18,2)").cast("double")


def price_currency(text: Column) -> Column:
    """ISO code of what stands before the first digit."""
    return iso_currency(F.regexp_extract(text, r"^[^0-9.,]*", 0))


def shipping_cost(text: Column) -> Column:
    """First number of a text that mentions delivery, else 0."""
    m = F.regexp_extract(text, r"[0-9]+(?:[.,][0-9]{1,2})?", 0)
    return F.when(F.contains(F.lower(text), F.lit("delivery")), F.coalesce(F.replace(m, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def listing_id(url: Column) -> Column:
    """At least ten digits after /itm/, else null."""
    return F.nullif(F.regexp_extract(url, r"/itm/\s*([0-9]{10,})\s*(?:\?|$)", 1), F.lit(""))


def clean_title(title: Column) -> Column:
    return F.trim(F.replace(F.replace(title, F.lit("Opens in a new window or tab")), F.lit("New listing")))


def condition(text: Column, known: dict[str, str] = CONDITIONS) -> Column:
    """The first known text contained, ignoring case; NULL (the string) if none."""
    return reduce(lambda c, kv: c.when(F.contains(F.lower(text), F.lit(kv[0].lower())), kv[1]), known.items(), F.when(F.lit(False), "")).otherwise("NULL")


def listing_status(warning: Column, message: Column, title: Column) -> Column:
    has = lambda *parts: reduce(lambda a, b: a | b, (F.contains(message, F.lit(p)) for p in parts))
    return (
        F.when(F.coalesce(F.contains(F.lower(warning), F.lit("out of stock")), F.lit(False)), "OutOfStock")
        .when(message.isNull(), F.when(title.isNull(), "Unknown").otherwise("Active"))
        .when(has("Bidding ended on ", "This listing was ended"), "Ended")
        .when(has("Item sold on", "This listing sold on", "This Buy It Now listing sold on"), "Sold")
        .otherwise("Active")
    )


def purchase_format(buttons: Column, price_text: Column) -> Column:
    b = lambda t: F.coalesce(F.contains(buttons, F.lit(t)), F.lit(False))
    return (
        F.when(b("Submit bid") & b("Make offer"), "AuctionWithBestOffer")
        .when(b("Buy it now") & b("Make offer"), "BuyItNowWithBestOffer")
        .when(b("Submit bid"), "Auction")
        .when(b("Buy it now"), "BuyItNow")
        .when(price_text.isNull(), "Unknown")
        .when(F.contains(F.lower(price_text), F.lit("best offer")), "BuyItNowWithBestOffer")
        .otherwise("BuyItNow")
    )


def buying_format(classes: Column) -> Column:
    return F.when(F.contains(classes, F.lit("bid")), "AUCTION").otherwise("BUY_NOW")


def search_url(base: str, term: Column, sold: Column, page: Column) -> Column:
    """Search address with the encoded term and flags."""
    return F.concat(F.lit(f"{base}/sch/i.html?_nkw="), F.url_encode(term), F.when(sold, F.lit("&LH_Sold=1&LH_Complete=1")).otherwise(F.lit("")), F.lit("&_pgn="), page.cast("string"))


def pair_prompt(title_a: Column, desc_a: Column, title_b: Column, desc_b: Column, longest: int = 500) -> Column:
    part = lambda d: F.substring(F.coalesce(d, F.lit("")), 1, longest)
    return F.concat(F.lit("Listing A: "), title_a, F.lit("\n"), part(desc_a), F.lit("\nListing B: "), title_b, F.lit("\n"), part(desc_b))


def llm_json(answer: Column) -> Column:
    """Map in the outermost braces of an answer, code fences aside; null if it doesn't parse or has only nulls."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "map<string,string>")
    kept = F.map_filter(parsed, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def sold_date(text: Column) -> Column:
    """Date after 'Sold', as '25 Nov 2025'."""
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(?i)Sold\s+(\d{1,2}\s+\w{3}\s+\d{4})", 1), F.lit("")), F.lit("d MMM yyyy")))


def ended_at(text: Column, as_of: Column) -> Column:
    """'sold on Sun, 4 May at 11:21 AM' in the year of `as_of`, or the year before if that is still to come."""
    found = F.regexp_extract(text, r"(\d{1,2} \w{3}) at (\d{1,2}:\d{2} [AP]M)", 0)
    this = lambda year: F.try_to_timestamp(F.concat(found, F.lit(" "), year.cast("string")), F.lit("d MMM 'at' h:mm a yyyy"))
    t = this(F.year(as_of))
    return F.when(t > as_of, this(F.year(as_of) - 1)).otherwise(t)


def ids_from_text(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("int")), lambda v: v.isNotNull())
