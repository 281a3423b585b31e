"""Under which desk an article is filed: keyword rules in order, guards over a proposed desk, and the final decision.

Nulls count as empty texts. Every rule looks at whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import desk_lexicons as D
from ..functions import text as X


def _text(c: Column | str) -> Column:
    return F.coalesce(X.col(c), F.lit(""))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return reduce(lambda out, pair: out.when(key == pair[0], pair[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values()))))


def known_label(label: Column) -> Column:
    """A label as one of the desks; older labels are mapped, anything else is National."""
    raw = F.trim(_text(label))
    return F.when(raw.isin(*D.DESKS), raw).otherwise(F.coalesce(_mapped(F.lower(raw), D.OLD_LABELS), F.lit("National")))


def proposed(answer: Column) -> Column:
    """The first desk whose name a model's answer holds; null if none."""
    low = F.lower(F.trim(_text(answer)))
    return F.coalesce(*(F.when(low.contains(d.lower()), d) for d in D.DESKS))


def india_context(text: Column, source: Column) -> Column:
    """``text`` is in lower case with a space at both ends."""
    return X.any_part(F.lower(F.trim(_text(source))), D.INDIA_SOURCES) | X.any_part(text, D.INDIA_PARTS)


SIGNALS = (
    "tech", "sports", "election", "entertainment", "business", "lifestyle", "state", "india", "india_source", "global_source", "final_india", "final_state", "final_tech",
)


def signals(articles: DataFrame) -> DataFrame:
    """Adds a boolean column ``_desk_<name>`` for each of SIGNALS. They are columns of their own, not a struct: the optimiser
    opens structs and would look a list up again in each rule that asks for it."""
    text, source = F.col("_desk_text"), F.col("_desk_source")
    found = {
        "tech": X.any_keyword(text, D.TECH), "sports": X.any_part(text, D.SPORTS_PARTS), "election": X.any_keyword(text, D.ELECTION),
        "entertainment": X.any_keyword(text, D.ENTERTAINMENT), "business": X.any_keyword(text, D.BUSINESS), "lifestyle": X.any_keyword(text, D.LIFESTYLE),
        "state": X.any_part(text, D.STATE), "india": india_context(text, source), "india_source": X.any_part(source, D.INDIA_SOURCES),
        "global_source": X.any_part(source, D.GLOBAL_SOURCES), "final_india": X.any_part(text, D.FINAL_INDIA_PARTS),
        "final_state": X.any_part(text, D.FINAL_STATE_PARTS), "final_tech": X.any_part(text, D.FINAL_TECH_PARTS),
    }
    whole = F.lower(F.concat(F.lit(" "), _text("title"), F.lit(" "), _text("body"), F.lit(" ")))
    rows = articles.withColumns({"_desk_text": whole, "_desk_source": F.lower(F.trim(_text("source")))})
    return rows.withColumns({f"_desk_{name}": found[name] for name in SIGNALS}).drop("_desk_text", "_desk_source")


def by_rules(s: dict[str, Column], hint: Column) -> Column:
    """The desk that the keyword rules name; ``s`` holds the columns of ``signals`` by name."""
    hinted = _mapped(hint, D.HINT_DESKS)
    hinted = F.when((hinted == "International") & s["india"], "National").when(hinted.isin("National", "State") & ~s["india"] & s["global_source"], "International").otherwise(hinted)
    rules = (
        F.when(s["tech"], "Technology").when(s["sports"], "Sports").when(s["election"] & s["india"], "Assembly Elections").when(s["entertainment"], "Entertainment")
        .when(s["business"], "Finance").when(s["lifestyle"], "Lifestyle").when(s["state"], "State")
    )
    return rules.otherwise(F.coalesce(hinted, F.when(s["india"], "National").otherwise("International")))


def guarded(desk: Column, rules: Column, s: dict[str, Column], hint: Column) -> Column:
    """A proposed desk held against the rules' desk; a null proposal gives the rules' desk."""
    home = ("National", "State", "Finance", "Sports", "Entertainment", "Lifestyle")
    abroad = ("International", "Technology", "Finance", "Sports", "Entertainment", "Lifestyle")
    return (
        F.when(desk.isNull(), rules)
        .when((hint == "tech") | s["tech"], "Technology").when((hint == "business") | s["business"], "Finance").when(hint == "sports", "Sports")
        .when(s["election"] & s["india"], "Assembly Elections").when(s["state"], "State")
        .when(s["india_source"] & desk.isin("International", "State"), F.when(rules.isin(*home), rules).otherwise("National"))
        .when(~s["india"] & desk.isin("National", "State"), F.when(rules.isin(*abroad), rules).otherwise("International"))
        .when((desk == "International") & s["india"], F.when(rules.isin("National", "State", "Assembly Elections"), rules).otherwise("National"))
        .otherwise(desk)
    )


def final(decided: Column, s: dict[str, Column], hint: Column, source: Column, source_url: Column, url: Column) -> Column:
    """The desk that a card is filed under."""
    at, of = F.lower(_text(url)), F.lower(_text(source_url))
    world = X.any_part(of, D.WORLD_SECTIONS) | X.any_part(at, D.WORLD_SECTIONS)
    explicit = at.contains("/india/") | at.contains("/news/national/") | s["final_india"]
    india = explicit | (X.any_part(F.lower(_text(source)), D.FINAL_INDIA_SOURCES) & ~world)
    label = known_label(decided)
    return (
        F.when((hint == "tech") | s["final_tech"], "Technology").when(hint == "sports", "Sports").when(hint == "business", "Finance").when(s["final_state"], "State")
        .when((hint == "international") & ~india, "International").when(india & label.isin("International", "State"), "National").otherwise(label)
    )


def desks(articles: DataFrame, answer: Column | None = None) -> DataFrame:
    """Adds ``rules_desk``, ``guarded_desk`` and ``desk``. Expects title, body, source, source_url, url, category (the run's
    hint); ``answer`` is a model's answer, none by default. No shuffle: one pass over the articles."""
    s = {name: F.col(f"_desk_{name}") for name in SIGNALS}
    hint = F.col("_desk_hint")
    rows = signals(articles.withColumn("_desk_hint", F.lower(F.trim(_text("category"))))).withColumn("rules_desk", by_rules(s, hint))
    model = F.lit(None).cast("string") if answer is None else proposed(answer)
    rows = rows.withColumn("guarded_desk", guarded(model, F.col("rules_desk"), s, hint))
    rows = rows.withColumn("desk", final(F.col("guarded_desk"), s, hint, F.col("source"), F.col("source_url"), F.col("url")))
    return rows.drop("_desk_hint", *(f"_desk_{name}" for name in SIGNALS))


def low_signal(title: Column, url: Column, category: Column, want_breaking: Column) -> Column:
    """True for light items where breaking news is wanted."""
    text = F.lower(F.concat(F.lit(" "), _text(title), F.lit(" "), _text(url), F.lit(" ")))
    soft = X.any_part(text, D.SOFT_PARTS) | (F.coalesce(category == "international", F.lit(False)) & X.any_part(text, D.SOFT_ABROAD))
    return F.coalesce(want_breaking, F.lit(False)) & soft
