"""Queries over the tables of a directory, one for each operator, and SQL for DuckDB that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import matching as M
from textloom.functions import sql as S
from textloom.operators import grep as G
from textloom.sources.lines import lines_of, scratch_dir
from textloom.streaming.search import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(_table(spark, sf_dir, table))
    if sql:
        SQL[name] = sql


def _filter(name: str, table: str, key: str, column: str, pattern: str, condition: str | None, invert: bool = False, **options) -> None:
    def make(df: DataFrame) -> DataFrame:
        test = M.is_match(column, pattern, **options)
        return df.where(~test if invert else test).select(key)

    _add(name, table, make, condition and f"SELECT {key} FROM {table} WHERE {condition}")


def _count(name: str, table: str, key: str, column: str, pattern: str, counted: str | None, **options) -> None:
    """counted: an RE2 pattern with as many matches, or an SQL expression (with SELECT's columns) after '='."""
    expression = counted[1:] if counted and counted.startswith("=") else f"len(regexp_extract_all({column}, '{counted}'))"
    _add(name, table, lambda df: df.select(key, M.count_matches(column, pattern, **options).alias("n")), counted and f"SELECT {key}, ({expression})::BIGINT AS n FROM {table}")


def _spread(name: str, table: str, key: str, column: str, value: Callable[[], Column], sql: str | None) -> None:
    """A row for each element of an array: key, n (from 1), match."""
    _add(name, table, lambda df: df.select(key, F.posexplode(value()).alias("at", "match")).select(key, (F.col("at") + 1).cast("long").alias("n"), "match"), sql)


def _unnest(table: str, key: str, column: str, pattern: str, group: int = 0) -> str:
    return f"SELECT {key}, n::BIGINT AS n, match FROM (SELECT {key}, unnest(l) AS match, generate_subscripts(l, 1) AS n FROM (SELECT {key}, regexp_extract_all({column}, '{pattern}', {group}) AS l FROM {table}))"


_LINES = "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::BIGINT AS line_no FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> ''))"

#: The words of a text, each with what stands between it and the next one.
_WORDS = r"regexp_extract_all(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+[^0-9A-Za-z_\x{80}-\x{10FFFF}]*')"
_PAIRS = "|".join(c + c for c in "abcdefghijklmnopqrstuvwxyz")

# -- tests, filters
_filter("is_match", "documents", "doc_id", "text", "[A-Z][a-z]+ing", "regexp_matches(text, '[A-Z][a-z]+ing')")
_filter("invert_match", "documents", "doc_id", "text", "[A-Z][a-z]+ing", "NOT regexp_matches(text, '[A-Z][a-z]+ing')", invert=True)
_filter("literal_match", "documents", "doc_id", "text", "Licensed under", "contains(text, 'Licensed under')")
_filter("literal_alternatives", "documents", "doc_id", "text", "GNU|Creative|Apache", "contains(text, 'GNU') OR contains(text, 'Creative') OR contains(text, 'Apache')")
_filter("string_anchors", "documents", "doc_id", "text", r"\A(?:The|Of)[a-z]* .*\.\Z", r"regexp_matches(text, '\A(The|Of)[a-z]* .*\.(\n?\z)')")
_filter("starts_with", "documents", "doc_id", "text", r"\AThe", "starts_with(text, 'The')")
_filter("ends_with", "documents", "doc_id", "text", r"and\.\z", "ends_with(text, 'and.')")
_filter("alternation", "events", "event_id", "event_type", r"\A(?:click|view)\z", "event_type IN ('click', 'view')")
_filter("ignore_case", "documents", "doc_id", "text", "(?i)STRAẞE|licensed", "regexp_matches(text, '(?i:licensed)|[sSſ][tT][rR][aA](ß|ẞ|[sSſ][sSſ])[eE]')")
_filter("case_option", "documents", "doc_id", "text", "gnu|apache", "regexp_matches(text, '(?i)gnu|apache')", ignore_case=True)
_filter("negative_lookahead", "pages", "page_id", "url", r"//(?!www\.|m\.|blog\.)[a-z]", r"regexp_matches(url, '//[a-z]') AND NOT regexp_matches(url, '//(www|m|blog)\.')")
_filter("counted_quantifier", "customer", "c_custkey", "c_name", r"#0*[1-9]\d{1,2}\z", "regexp_matches(c_name, '#0*[1-9][0-9]{1,2}$')")
_filter("possessive", "part", "p_partkey", "p_name", r"\A[a-z]++ w[a-z]++\z", "regexp_matches(p_name, '^[a-z]+ w[a-z]+$')")
_filter("atomic", "part", "p_partkey", "p_name", r"\A(?>[a-z]+) (?>b|w|bo|wi)olt", "regexp_matches(p_name, '^[a-z]+ [bw]olt')")
# a balanced pair holds an innermost one
_filter("recursion", "documents", "doc_id", "text", r"\((?:[^()]++|\g<0>)*\)", r"regexp_matches(text, '\([^()]*\)')")
_filter("pathological", "documents", "doc_id", "text", "a?" * 20 + "e" * 2 + "a" * 1, "contains(text, 'eea')")
_filter("backreference_words", "documents", "doc_id", "text", r"\b([a-z]+) \1\b", f"len(list_filter(range(1, len({_WORDS})), lambda i: regexp_full_match({_WORDS}[i], '[a-z]+ ') AND rtrim({_WORDS}[i], ' ') = regexp_replace({_WORDS}[i + 1], '[^0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+$', ''))) > 0")
_filter("possessive_fails", "part", "p_partkey", "p_name", "[a-z]++t", "false")
_filter("greedy_gives_back", "part", "p_partkey", "p_name", "[a-z]+t", "regexp_matches(p_name, '[a-z]+t')")

# -- counts
_count("count_matches", "documents", "doc_id", "text", "[0-9]+", "[0-9]+")
_count("lookahead", "documents", "doc_id", "text", "[A-Za-z]+(?=,)", "[A-Za-z]+,")
_count("lookbehind", "documents", "doc_id", "text", r"(?<=\. )[A-Z][a-z]+", r"\. [A-Z][a-z]+")
_count("negative_lookbehind", "documents", "doc_id", "text", r"(?<!\. )The", r"=len(regexp_extract_all(text, 'The')) - len(regexp_extract_all(text, '\. The'))")
_count("lookbehind_unbounded", "pages", "page_id", "url", r"(?<=//[a-z.-]*)[.-]", "=len(regexp_extract_all(regexp_extract(url, '//[a-z.-]*'), '[.-]'))")
_count("unicode_class", "documents", "doc_id", "text", r"\p{Lu}\p{Ll}+", r"\p{Lu}\p{Ll}+")
_count("unicode_script", "documents", "doc_id", "text", r"\p{Script=Latin}+", r"\p{Latin}+")
_count("shorthand_word", "pages", "page_id", "url", r"\w+", "[0-9A-Za-z_]+")
_count("class_intersection", "documents", "doc_id", "text", "[a-z&&[^aeiou]]{4,}", "[b-df-hj-np-tv-z]{4,}")
_count("class_nested", "documents", "doc_id", "text", "[[a-f][0-9]]{6,}", "[a-f0-9]{6,}")
_count("posix_class", "documents", "doc_id", "text", "[[:digit:]]+[[:punct:]]", "[[:digit:]]+[[:punct:]]")
_count("line_anchors", "documents", "doc_id", "text", r"^[A-Z][^\n]*\.$", r"(?m)^[A-Z][^\n]*\.$")
_count("word_boundary", "pages", "page_id", "url", r"\ben\b", r"\ben\b")
_count("lazy_quantifier", "pages", "page_id", "html", "<p>.*?</p>", "<p>.*?</p>")
_count("dot_all", "documents", "doc_id", "text", r"(?m)\n.*?\n", r"(?s)\n.*?\n")
_count("extended_layout", "documents", "doc_id", "text", "(?x) [0-9]+ \\. [0-9]+  # two numbers\n (?#no more)", r"[0-9]+\.[0-9]+")
_count("escapes", "documents", "doc_id", "text", r"\x54he\x{20}\141", "The a")
_count("subexpression_call", "documents", "doc_id", "text", r"(?<n>[0-9]{1,3})\.\g<n>\.\g<n>\.\g<n>", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")
_count("case_fold_class", "documents", "doc_id", "text", "(?i)[ß]", "ß|ẞ|[sSſ][sSſ]")
_count("absence_comment", "pages", "page_id", "html", "<!--(?~-->)-->", "(?s)<!--.*?-->")
_count("conditional", "documents", "doc_id", "text", r"(\()?[0-9]{3}(?(1)\)|-)", r"\([0-9]{3}\)|[0-9]{3}-")
# words that equal the next one, as a text of 1 and 0: a match takes a 1 and, as its second word is used up, what follows it
_PAIRED = "SELECT doc_id, len(regexp_extract_all(array_to_string(list_transform(range(1, greatest(1, len(w))), lambda i: CASE WHEN regexp_full_match(w[i], '[a-z]+ ') AND rtrim(w[i], ' ') = regexp_replace(w[i + 1], '[^0-9A-Za-z_\\x{80}-\\x{10FFFF}]+$', '') THEN '1' ELSE '0' END), ''), '1[01]?'))::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(%s, '[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+[^0-9A-Za-z_\\x{80}-\\x{10FFFF}]*') AS w FROM documents)"
_count("backreference", "documents", "doc_id", "text", r"\b([a-z]+) \1\b", "0")
_count("backreference_ignore_case", "documents", "doc_id", "text", r"(?i)\b([a-z]+) \1\b", "0")
SQL["backreference"], SQL["backreference_ignore_case"] = _PAIRED % "text", _PAIRED % "lower(text)"

# atomic and possessive parts keep what they took: `(?>e|er)s` never takes `ers`
_count("atomic_alternatives", "documents", "doc_id", "text", "(?>e|er)s", "es")
_count("alternatives_in_turn", "documents", "doc_id", "text", "(?:e|er)s", "(e|er)s")
_count("possessive_optional", "documents", "doc_id", "text", "e?+es", "ees")
_count("optional_in_turn", "documents", "doc_id", "text", "e?es", "e?es")
_count("search_start_anchor", "documents", "doc_id", "text", r"\G[A-Za-z]", "=len(regexp_extract(text, '^[A-Za-z]*'))")
_count("not_word_boundary", "pages", "page_id", "url", r"\Be", r"\Be")
_count("named_backreference", "documents", "doc_id", "text", r"(?<q>[a-z])\k<q>", _PAIRS)
_count("quoted_backreference", "documents", "doc_id", "text", r"(?<q>[a-z])\k'q'", _PAIRS)
_count("relative_backreference", "documents", "doc_id", "text", r"([a-z])(\k<-1>)", _PAIRS)
_count("level_backreference", "documents", "doc_id", "text", r"(?<q>[a-z])\k<q+1>", _PAIRS)
_count("folded_backreference", "pages", "page_id", "html", r"(?i)([a-z])\1", f"(?i){_PAIRS}")
_count("relative_call", "documents", "doc_id", "text", r"([0-9]{2})(-\g<-1>)", "[0-9]{2}-[0-9]{2}")
_count("next_call", "documents", "doc_id", "text", r"\g<+1>-([0-9]{2})", "[0-9]{2}-[0-9]{2}")
_count("whole_call", "pages", "page_id", "url", r"[a-z](?:-\g<0>)?", "[a-z](-[a-z])*")
_count("absence", "pages", "page_id", "html", "<p>(?~<[/b])<", "(?s)<p>(?:[^<]|<[^/b])*?<[/b]")
_count("simple_escapes", "documents", "doc_id", "text", r"[\n\t\r\f\v\a\e]", r"[\n\t\r\f\x0b\x07\x1b]")
_count("unicode_escapes", "documents", "doc_id", "text", r"ß|ü|\x{E4}", "[ßüä]")
_count("octal_escapes", "documents", "doc_id", "text", r"\060|\101", "0|A")
_count("control_escapes", "documents", "doc_id", "text", r"\cJ|\C-J", r"\n")
_count("meta_escapes", "documents", "doc_id", "text", r"\M-\C-J|\M-d", "[\x8a\xe4]")
_count("line_break_escape", "documents", "doc_id", "text", r"\R", r"\s")
_count("any_property", "documents", "doc_id", "text", r"\p{Any}", "=length(text)")
_count("assigned_property", "documents", "doc_id", "text", r"\p{Assigned}{4}", "=length(text) // 4")
_count("posix_properties", "documents", "doc_id", "text", r"\p{Upper}\p{Lower}|\p{Digit}\p{Punct}", r"\p{Lu}\p{Ll}|[0-9][!-/:-@\[-`{-~]")
_count("negated_property", "documents", "doc_id", "text", r"\P{L}\p{^L}", r"\P{L}\P{L}")
_count("script_extensions", "documents", "doc_id", "text", r"\p{scx=Latin}+", r"\p{Latin}+")
_count("class_escapes", "documents", "doc_id", "text", r"[\d.]+", "[0-9.]+")
_count("class_properties", "documents", "doc_id", "text", r"[\p{Lu}\d]+", r"[\p{Lu}0-9]+")
_count("fold_of_ranges", "documents", "doc_id", "text", "(?i)[a-c]+", "(?i)[a-c]+")
_count("fold_of_literals", "documents", "doc_id", "text", "(?i:the)", "(?i:the)")
_count("fold_alternatives", "documents", "doc_id", "text", "(?i)ss|x", "[sSſ][sSſ]|ß|ẞ|[xX]")
_count("empty_pattern", "documents", "doc_id", "text", "", "=length(text) + 1")
_count("trailing_context", "documents", "doc_id", "text", "e(?!r)", "=len(regexp_extract_all(text, 'e')) - len(regexp_extract_all(text, 'er'))")
_count("forced_matcher", "documents", "doc_id", "text", "[A-Z][a-z]+", "[A-Z][a-z]+", force_tier="L2")
_count("forced_jvm", "documents", "doc_id", "text", "[A-Z][a-z]+", "[A-Z][a-z]+", force_tier="L1")
_count("ascii_option", "documents", "doc_id", "text", r"\w+", r"[0-9A-Za-z_]+", ascii_only=True)
_count("empty_pattern_matcher", "conversations", "conv_id", "text", "", "=length(text) + 1", force_tier="L2")


def _many(name: str, table: str, key: str, column: str, patterns: dict[str, tuple[str, str]]) -> None:
    """Counts of several patterns at once: column name -> (pattern, RE2 pattern or SQL expression after '=')."""
    sql = ", ".join(f"({re2[1:] if re2[0] == '=' else f'len(regexp_extract_all({column}, {chr(39)}{re2}{chr(39)}))'})::BIGINT AS {k}" for k, (_, re2) in patterns.items())
    _add(name, table, lambda df: df.select(key, *(M.count_matches(column, p).alias(k) for k, (p, _) in patterns.items())), f"SELECT {key}, {sql} FROM {table}")


_POSIX = "alnum alpha ascii blank cntrl digit graph lower print punct space upper xdigit word".split()
_many("posix_classes", "pages", "page_id", "url", {f"n_{k}": (f"[[:{k}:]]", f"[[:{k}:]]") for k in _POSIX})
_many("posix_spaces", "conversations", "conv_id", "text", {f"n_{k}": (f"[[:{k}:]]", f"[[:{k}:]]") for k in ("blank", "cntrl", "space", "punct", "digit", "xdigit")})
_many("shorthands", "pages", "page_id", "url", {"w": (r"\w", r"\w"), "not_w": (r"\W", r"\W"), "d": (r"\d", r"\d"), "not_d": (r"\D+", r"\D+"), "h": (r"\h+", "[0-9a-fA-F]+"), "not_h": (r"\H", "[^0-9a-fA-F]")})
_many("shorthand_spaces", "documents", "doc_id", "text", {"s": (r"\s", r"=len(regexp_extract_all(text, '[\s\x0b\x85\p{Z}]'))"), "not_s": (r"\S+", r"[^\s\x0b\x85\p{Z}]+")})
_many("general_categories", "documents", "doc_id", "text", {k: (rf"\p{{{p}}}", rf"\p{{{p}}}") for k, p in (("lu", "Lu"), ("ll", "Ll"), ("nd", "Nd"), ("po", "Po"), ("sm", "Sm"), ("zs", "Zs"), ("letters", "L"), ("punctuation", "P"))})

# -- texts, offsets, captures
_add("empty_match", "documents", lambda df: df.select("doc_id", M.find_text("text", "A*").alias("match"), M.extract("text", "(?:[0-9]|$)*", 0).alias("first")), "SELECT doc_id, CASE WHEN text IS NOT NULL THEN regexp_extract(text, '^A*') END AS match, CASE WHEN text IS NOT NULL THEN regexp_extract(text, '^[0-9]*') END AS first FROM documents")
_add("null_loop", "documents", lambda df: df.select("doc_id", M.captures("text", "(?:([A-Z]*))*").alias("c")).select("doc_id", F.col("c.match.end").alias("stop"), F.element_at("c.groups", 1)["text"].alias("last")), "SELECT doc_id, strlen(regexp_extract(text, '^[A-Z]*'))::BIGINT AS stop, CASE WHEN text IS NOT NULL THEN '' END AS last FROM documents")
_add("group_counts", "pages", lambda df: df.select("page_id", M.captures("url", "(h)(t+)(x)?").alias("c"), M.captures("url", "h").alias("d")).select("page_id", M.captures_len(F.col("c")).cast("long").alias("n_groups"), M.captures_empty(F.col("c")).alias("none"), M.captures_empty(F.col("d")).alias("none_at_all"), F.lit(M.group_count("(h)(t+)(x)?")).cast("long").alias("n_known")), "SELECT page_id, 3::BIGINT AS n_groups, false AS none, true AS none_at_all, 3::BIGINT AS n_known FROM pages WHERE contains(url, 'ht')")
_add("find_from", "documents", lambda df: df.select("doc_id", M.find_from("text", "(?<=e)r", 40).alias("m")).select("doc_id", F.col("m.start").alias("start")), "SELECT doc_id, CASE WHEN position('er' IN text[40:]) > 0 THEN strlen(text[:39]) + strlen(string_split(text[40:], 'er')[1]) + 1 END::BIGINT AS start FROM documents")
_add("replace_matcher", "pages", lambda df: df.select("page_id", M.replace_all("url", r"([a-z])\1", "_").alias("url")), f"SELECT page_id, regexp_replace(url, '{_PAIRS}', '_', 'g') AS url FROM pages")
_BAD = ("(", "[a", r"\k<+1>(a)", r"\k<0>", r"\g<2>(a)", r"\p{Nope}", "(?(0))", "[z-a]", "a{3,2}", "a\\")
QUERIES["compile_errors"] = lambda spark, sf_dir: spark.createDataFrame([(p, S.check(p) is not None) for p in (*_BAD, "a", r"(a)\1", r"\-")], "pattern string, fails boolean")
SQL["compile_errors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(p in _BAD).lower()})" for p in (*_BAD, "a", r"(a)\1", r"\-")) + ") AS t(pattern, fails)"
_spread("find_all_text", "conversations", "conv_id", "text", lambda: M.find_all_text("text", "[A-Z][a-z]+"), _unnest("conversations", "conv_id", "text", "[A-Z][a-z]+"))
_spread("find_all_tags", "pages", "page_id", "html", lambda: F.transform(M.captures_all("html", "<([a-z]+)[^>]*>"), lambda c: c["groups"][0]["text"]), _unnest("pages", "page_id", "html", "<([a-z]+)[^>]*>", 1))
_spread("captures_email", "documents", "doc_id", "text", lambda: F.transform(M.captures_all("text", r"([a-z0-9.]+)@([a-z0-9.]+)"), lambda c: c["groups"][1]["text"]), _unnest("documents", "doc_id", "text", r"([a-z0-9.]+)@([a-z0-9.]+)", 2))
_spread("keep", "pages", "page_id", "html", lambda: F.transform(M.find_all("html", r"<h1>\K[^<]+"), lambda m: m["text"]), _unnest("pages", "page_id", "html", "<h1>([^<]+)", 1))
_spread("split", "pages", "page_id", "url", lambda: M.split("url", "[/?#]+"), "SELECT page_id, n::BIGINT AS n, match FROM (SELECT page_id, unnest(l) AS match, generate_subscripts(l, 1) AS n FROM (SELECT page_id, string_split_regex(url, '[/?#]+') AS l FROM pages))")
_add("find_text", "documents", lambda df: df.select("doc_id", M.find_text("text", "[0-9]{3,}").alias("match")), "SELECT doc_id, nullif(regexp_extract(text, '[0-9]{3,}'), '') AS match FROM documents")
_add("byte_offset", "documents", lambda df: df.select("doc_id", M.find("text", "er").alias("m")).select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("stop")).where("start IS NOT NULL"), "SELECT doc_id, strlen(string_split(text, 'er')[1])::BIGINT AS start, strlen(string_split(text, 'er')[1])::BIGINT + 2 AS stop FROM documents WHERE contains(text, 'er')")
_add("capture_json", "events", lambda df: df.select("event_id", M.extract("props", '"k": ([0-9]+)', 1).cast("long").alias("k")), """SELECT event_id, try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""")
_add("capture_unset", "documents", lambda df: df.select("doc_id", M.captures("text", r"(\+1 )?\(([0-9]{3})\)").alias("c")).select("doc_id", F.col("c").isNotNull().alias("found"), F.try_element_at("c.groups", F.lit(1))["text"].isNotNull().alias("prefixed")), r"SELECT doc_id, regexp_matches(text, '\([0-9]{3}\)') AS found, coalesce(regexp_extract(text, '(\+1 )?\([0-9]{3}\)', 1), '') <> '' AS prefixed FROM documents")
_URL = r"(?<scheme>https?)://(?<host>[^/]+)(?<path>/[^?#]*)"
_add("named_captures", "pages", lambda df: df.select("page_id", M.captures("url", _URL).alias("c")).select("page_id", *(M.group(F.col("c"), _URL, k)["text"].alias(k) for k in ("scheme", "host", "path"))), "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(url, '(https?)://([^/]+)(/[^?#]*)', {i}), '') AS {k}" for i, k in ((1, "scheme"), (2, "host"), (3, "path"))) + " FROM pages")
_add("replace_all", "pages", lambda df: df.select("page_id", M.replace_all("url", "[0-9]+", "N").alias("url")), "SELECT page_id, regexp_replace(url, '[0-9]+', 'N', 'g') AS url FROM pages")
_add("highlight", "pages", lambda df: df.select("page_id", M.highlight("url", "[a-z]+", "[", "]").alias("url")), r"SELECT page_id, regexp_replace(url, '([a-z]+)', '[\1]', 'g') AS url FROM pages")

# -- lines
_add("lines", "documents", lambda df: lines_of(df, "text", "doc_id"), f"SELECT doc_id, line_no, rtrim(line, chr(13)) AS line FROM {_LINES}")
_add("grep_lines", "documents", lambda df: G.select_lines(lines_of(df, "text", "doc_id"), "^The").select("doc_id", "line"), f"SELECT doc_id, line FROM {_LINES} WHERE starts_with(line, 'The')")
_add("grep_invert", "documents", lambda df: G.select_lines(lines_of(df, "text", "doc_id"), "[aeiou]{3}", invert=True).select("doc_id", "line"), f"SELECT doc_id, line FROM {_LINES} WHERE NOT regexp_matches(line, '[aeiou]{{3}}')")
_add("grep_line_number", "documents", lambda df: G.select_lines(lines_of(df, "text", "doc_id"), "[0-9]{4}").select("doc_id", "line_no"), f"SELECT doc_id, line_no FROM {_LINES} WHERE regexp_matches(line, '[0-9]{{4}}')")
_add("grep_count", "documents", lambda df: G.count_lines(lines_of(df, "text", "doc_id"), "[0-9]{4}", "doc_id", every=df), f"SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {_LINES} WHERE regexp_matches(line, '[0-9]{{4}}') GROUP BY doc_id) c USING (doc_id)")
_add("grep_list", "documents", lambda df: G.list_keys(lines_of(df, "text", "doc_id"), "[0-9]{4}", "doc_id"), f"SELECT DISTINCT doc_id FROM {_LINES} WHERE regexp_matches(line, '[0-9]{{4}}')")
_add("grep_only_matching", "conversations", lambda df: G.only_matching(df, "[A-Z][a-z]+", "conv_id", "turn", column="text"), "SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS match FROM conversations")
_add("grep_stdin", "conversations", lambda df: G.Grep(df.sparkSession, "THE", source=df.select(F.col("text").alias("line"), "conv_id"), ignore_case=True).rows(), "SELECT text AS line FROM conversations WHERE regexp_matches(text, '(?i)the')")
_add("grep_stdin_count", "conversations", lambda df: G.Grep(df.sparkSession, "[aeiou]{2}", source=df.select(F.col("text").alias("line")), count=True, invert=True).rows(), "SELECT count(*)::BIGINT AS n FROM conversations WHERE NOT regexp_matches(text, '[aeiou]{2}')")


_written: dict[tuple[str, str], str] = {}


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The texts of conversations as a tree of text files, a directory with a space in its name for each
    role; written once for an application and its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _written:
        return _written[key]
    out = _written[key] = f"{scratch_dir(spark)}/textloom-files-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.concat(F.lit("role of "), "role").alias("role"), F.regexp_replace("text", "[\r\n]", " ").alias("text")).write.partitionBy("role").text(out)
    return out


def _role(path: str = "path") -> Column:
    return F.regexp_extract(path, "role=role of ([^/]*)/", 1).alias("role")


def _grep_files(name: str, pattern: str, make: Callable[[DataFrame], DataFrame], sql: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(G.Grep(spark, pattern, _files(spark, sf_dir), recursive=True, **options).rows())
    SQL[name] = sql


_FILES = "(SELECT role, regexp_replace(text, '[\r\n]', ' ', 'g') AS line FROM conversations WHERE text IS NOT NULL)"
_grep_files("grep_files", "^The", lambda df: df.select(_role(), "line"), f"SELECT role, line FROM {_FILES} WHERE starts_with(line, 'The')")
_grep_files("grep_files_count", "[0-9]", lambda df: df.groupBy(_role()).agg(F.sum("n").alias("n")), f"SELECT role, sum(regexp_matches(line, '[0-9]')::INT)::BIGINT AS n FROM {_FILES} GROUP BY role", count=True)
_grep_files("grep_files_list", "[a-z]", lambda df: df.select(_role()).distinct(), f"SELECT DISTINCT role FROM {_FILES} WHERE regexp_matches(line, '[a-z]')", list_files=True)


def _grep_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit statuses and messages of searches that find something, nothing, a directory, no file."""
    where = _files(spark, sf_dir)
    runs = {"found": ("[a-z]", [where], True), "nothing": ("\\A\\z\\A.", [where], True), "directory": ("[a-z]", [where], False), "missing": ("[a-z]", [where + "/none"], True), "missing_and_found": ("[a-z]", [where + "/none", where], True)}
    got = [(k, (o := G.Grep(spark, p, paths, recursive=r).outcome()).status, o.n_errors) for k, (p, paths, r) in runs.items()]
    return spark.createDataFrame(got, "search string, status long, n_errors long")


QUERIES["grep_status"] = _grep_status
SQL["grep_status"] = "SELECT * FROM (VALUES ('found', 0::BIGINT, 0::BIGINT), ('nothing', 1, 0), ('directory', 2, 1), ('missing', 2, 1), ('missing_and_found', 0, 1)) AS t(search, status, n_errors)"
_add("windowed_counts", "events", lambda df: windowed_counts(df, "ts", "event_type", "c|s", "1 hour"), "SELECT date_trunc('hour', ts) AS window_start, sum(regexp_matches(event_type, 'c|s')::INT)::BIGINT AS n_rows, sum(len(regexp_extract_all(event_type, 'c|s')))::BIGINT AS n_matches FROM events GROUP BY 1")


def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register(spark)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("textloom_pages")
    return spark.sql(r"SELECT page_id, rx_count(url, '[0-9]+') AS n, rx_find(url, '/[a-z]{2}/').start AS start FROM textloom_pages")


QUERIES["sql_functions"] = _sql_functions
SQL["sql_functions"] = "SELECT page_id, len(regexp_extract_all(url, '[0-9]+'))::BIGINT AS n, CASE WHEN regexp_matches(url, '/[a-z]{2}/') THEN strlen(regexp_extract(url, '^(.*?)/[a-z]{2}/', 1))::BIGINT END AS start FROM pages"


def _sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register(spark)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("textloom_pages")
    return spark.sql(r"SELECT page_id, r.match_no AS n, r.match FROM textloom_pages, LATERAL rx_find_rows(url, '[0-9]+') r")


QUERIES["sql_table_function"] = _sql_rows
SQL["sql_table_function"] = "SELECT page_id, n::INT AS n, match FROM (SELECT page_id, unnest(l) AS match, generate_subscripts(l, 1) AS n FROM (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS l FROM pages))"
