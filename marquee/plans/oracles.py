"""SQL (DuckDB dialect) that gives the same rows as the named queries, written without looking at their plans.

Learned clusters are found by the same passes as a recursive query: their seeds are chosen by digest, so SQL can choose them too.
"""

from __future__ import annotations

from ..config import GENRE_KEYWORDS, PRESETS, SWEEP
from ..functions.parsing import BLANKS
from ..operators.locale import COUNTRY_LANGUAGES, REGION_LANGUAGES, TIMEZONE_COUNTRY
from .views import USER_CODES, USER_COUNTRIES, USER_REGIONS, USER_ZONES

ORACLES: dict[str, str] = {}


def fixed(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values: list[str], index: str) -> str:
    return f"[{', '.join(text(v) for v in values)}][({index}) % {len(values)} + 1]"


def with_(*parts: str, select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select


STRIP = f"trim({{}}, {text(BLANKS)})"
PRESENT = "({0} is not null and {0} not in ('', 'N/A'))"

# --- shared table expressions ----------------------------------------------------------------------------------------

TITLES = """
li as (select l_partkey, count(*) as n_lines, max(year(l_shipdate)) as yr, sum(cast(l_quantity as bigint)) as qty,
         sum(cast(round(l_discount * 100) as bigint)) as disc from lineitem group by l_partkey),
places as (select l_partkey, list_sort(list(distinct n_name)) as country, list_sort(list(distinct r_name)) as language
         from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
         join region on n_regionkey = r_regionkey group by l_partkey),
titles as (select cast(p_partkey as bigint) as tid, p_name as title, cast(yr - p_partkey % 40 as int) as year,
         p_size as runtime, list_concat([p_type], string_split(p_name, ' ')) as genre, country, language, text as plot,
         case when p_partkey % 11 = 0 then null else floor(cast(qty as double) / n_lines * 2) / 10 end as rating,
         case when p_partkey % 7 = 0 then 0 else n_lines end as votes,
         case when p_partkey % 3 = 0 then null else cast(floor(cast(disc as double) * 10 / n_lines) as int) end as metascore,
         qty as quantity
         from part left join li on li.l_partkey = p_partkey left join places on places.l_partkey = p_partkey
         left join documents on doc_id = p_partkey)"""

FUSED = """
base as (select *, nullif(votes, 0)::double as v, rating::double / 10 as nr, metascore::double / 100 as nm from titles),
means as (select avg(v) as mv, avg(nr) as mr, avg(nm) as mm from base),
bayesian as (select base.*, mv, v / (v + mv) * nr + mv / (v + mv) * mr as bayes from base cross join means),
fused as (select *, coalesce((bayes + nm) / 2, bayes, nm) as final, abs(bayes - nm) * (least(v, mv) / mv) as heat
         from bayesian where bayes is not null or nm is not null)"""

BOUNDS = """
lows as (select min(v) as lo, max(v) as hi from fused),
scaled as (select fused.*, (v - lo) / (hi - lo) as sn_votes from fused cross join lows)"""

POPULAR = """
lifted as (select *, log10((coalesce(sn_votes, 0) + 1e-6) * 1000 + 1)
         + case when sn_votes > 0.1 then pow(sn_votes, 1.5) else 0 end as raw from {source}),
span as (select min(raw) as plo, max(raw) as phi from lifted),
popular as (select lifted.*, case when phi - plo > 1e-10 then (raw - plo) / (phi - plo) * 1.99 + 0.01 else 1.0 end as pop
         from lifted cross join span)"""


def features(source: str = "titles") -> str:
    """Vocabularies and sorted active features of a table with the title columns."""
    return f"""
cv as (select val, row_number() over (order by val) - 1 as idx
         from (select distinct unnest(country) as val from {source})),
lv as (select val, row_number() over (order by val) - 1 as idx
         from (select distinct unnest(language) as val from {source})),
gv as (select val, row_number() over (order by val) - 1 as idx
         from (select distinct unnest(genre) as val from {source})),
lf as (select tid, list_sort(list(distinct f)) as a from (
         select tid, idx as f from (select tid, unnest(country) as val from {source}) join cv using (val) union all
         select tid, idx + (select count(*) from cv) from (select tid, unnest(language) as val from {source}) join lv using (val))
         group by tid),
gf as (select tid, list_sort(list(distinct idx)) as a
         from (select tid, unnest(genre) as val from {source}) join gv using (val) group by tid),
la as (select t.tid, coalesce(a, []::bigint[]) as a from {source} t left join lf using (tid)),
ga as (select t.tid, coalesce(a, []::bigint[]) as a from {source} t left join gf using (tid))"""


COMBO = "('(' || array_to_string(a, ', ') || case when len(a) = 1 then ',)' else ')' end)"
LISTED = "('[' || array_to_string(a, ', ') || ']')"


def byte(digest: str, i: str) -> str:
    return f"(('0x' || substr({digest}, ({i}) * 2 + 1, 2))::int / 255.0::double)"


def wide_loc(a: str, i: str) -> str:
    """Value of a 128-dimensional localisation vector at position ``i``."""
    return f"""greatest(case when list_contains(list_transform({a}, lambda f: f * 17 % 64), {i}) then 0.8::double else 0 end,
    case when list_contains(list_transform({a}, lambda f: (f * 31 + 7) % 64 + 64), {i}) then 0.6::double else 0 end,
    case when list_contains(list_transform({a}[1:3], lambda f: (f * 53 + 13) % 32), {i}) then 0.3::double else 0 end)"""


def hashed(source: str, key: str, column: str, out: str, prefix: str = "") -> str:
    """64-dimensional hashed bag of words, as a list of doubles."""
    return f"""
{out}_words as (select {key}, unnest(regexp_split_to_array(lower({text(prefix)} || {column}), '[^\\p{{L}}\\p{{N}}]+')) as w from {source}),
{out}_counts as (select {key}, ('0x' || substr(md5(w), 1, 7))::int % 64 as b, count(*) as n
         from {out}_words where w <> '' group by all),
{out}_maps as (select {key}, map_from_entries(list((b, n))) as m, sqrt(sum(n * n)) as size from {out}_counts group by {key}),
{out} as (select {key}, list_transform(range(64), lambda i: coalesce(m[i], 0)::double / size) as p from {out}_maps)"""


def kmeans(source: str, out: str) -> str:
    """``{out}(gid, tid, cluster, k, distance)``: K-means within each group of ``source`` (gid, tid, v, k), ten starts, passes until no
    centre moves, and the start with the smallest inertia."""
    far = "list_transform({c}, lambda c: round(list_sum(list_transform(list_zip(c, {v}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9))"
    return f"""
{out}_points as materialized ({source}),
{out}_seeds as (select gid, start, list(v order by place) as centres from (
         select gid, start, v, k, row_number() over (partition by gid, start
           order by substr(md5(case when start = 0 then tid::varchar else start || ':' || tid end), 1, 13), tid) as place
         from {out}_points, range(10) as starts(start)) where place <= k group by gid, start),
{out}_passes as (
  select 0 as pass, gid, start, centres from {out}_seeds
  union all
  select pass + 1, gid, start, moved from (
    select pass, gid, start, any_value(centres) as centres, map_from_entries(list((label, mean))) as means,
      list_transform(range(1, len(any_value(centres)) + 1), lambda j: coalesce(map_from_entries(list((label, mean)))[j], any_value(centres)[j])) as moved
    from (
      select pass, gid, start, any_value(centres) as centres, label, list(x order by pos) as mean from (
        select pass, gid, start, any_value(centres) as centres, label, pos, avg(x) as x from (
          select pass, gid, start, centres, list_position(far, list_min(far)) as label, unnest(v) as x, generate_subscripts(v, 1) as pos from (
            select pass, gid, start, centres, v, {far.format(c="centres", v="v")} as far
            from {out}_passes join {out}_points using (gid)))
        group by pass, gid, start, label, pos)
      group by pass, gid, start, label)
    group by pass, gid, start)
  where list_max(list_transform(list_zip(moved, centres), lambda z: list_distance(z[1], z[2]))) > 1e-9),
{out}_scored as (
  select gid, start, tid, k, {far.format(c="centres", v="v")} as far
  from (select gid, start, arg_max(centres, pass) as centres from {out}_passes group by gid, start) join {out}_points using (gid)),
{out}_best as (
  select gid, start from (select gid, start, sum(list_min(far)) as inertia from {out}_scored group by gid, start)
  qualify row_number() over (partition by gid order by round(inertia, 6), start) = 1),
{out} as (
  select gid, tid, (list_position(far, list_min(far)) - 1)::int as cluster, k, list_min(far) as distance
  from {out}_scored join {out}_best using (gid, start))"""


def clusters(members: str, per_cluster: int, room: str) -> str:
    """Number of sub-clusters of a group."""
    return f"(case when {members} <= 1 then 1 else least({members}, greatest(2, {members} // {per_cluster}), greatest(1, {room})) end)::int"


# --- sources, selection and parsing ----------------------------------------------------------------------------------

RAW = """
raw as (select tid, 'tt' || case when length(tid::varchar) >= 7 then tid::varchar else lpad(tid::varchar, 7, '0') end as tconst,
         case tid % 5 when 0 then 'tvSeries' when 1 then 'tvMovie' else 'movie' end as "titleType",
         case when tid % 19 <> 0 then year end as "startYear", rating as "averageRating", quantity * 4 as "numVotes" from titles)"""

LOOSE = """
loose as (select tid, year, votes,
         case tid % 9 when 0 then 'N/A' when 1 then '  ' || title || ' ' else title end as title_text,
         case tid % 8 when 0 then year::varchar || '–' || (year + 4)::varchar when 1 then '' else year::varchar end as year_text,
         case tid % 7 when 0 then (runtime // 60)::varchar || 'h ' || (runtime % 60)::varchar || 'min'
           when 1 then runtime::varchar || ' min' when 2 then runtime::varchar when 3 then runtime::varchar || 'H'
           when 4 then '1,0' || runtime::varchar || ' min' when 5 then 'unknown' else 'N/A' end as runtime_text,
         array_to_string(genre, ', ') as genre_text,
         ' ' || array_to_string(genre, ' & ') || ' &  & ' as awards_text,
         case tid % 10 when 0 then 'N/A' when 1 then 'nan' when 2 then 'ten' else rating::varchar end as rating_text,
         case when tid % 6 = 0 then 'N/A' else (votes % 9 + 1)::varchar || ',' || lpad((tid % 1000)::varchar, 3, '0') end as votes_text,
         coalesce(metascore::varchar, 'N/A') as metascore_text, genre, plot,
         ['PG-13', ' R ', 'N/A', '', 'TV-14'][tid % 5 + 1] as rated_text,
         case when tid % 4 = 0 then 'N/A' else array_to_string(genre[2:3], ', ') end as director_text,
         array_to_string(genre[3:11], ' , ,') as actors_text, coalesce(array_to_string(language, ', '), '') as language_text,
         case when tid % 12 = 0 then 'N/A' else coalesce(array_to_string(country, ', '), '') end as country_text,
         case when tid % 5 = 0 then 'N/A' else 'posters/' || tid || '.jpg' end as poster_text from titles)"""


def as_list(column: str, sep: str) -> str:
    pieces = f"list_transform(string_split({column}, {text(sep)}), lambda x: {STRIP.format('x')})"
    return f"case when {PRESENT.format(column)} then list_filter({pieces}, lambda x: x <> '') else [] end"


def as_int(column: str) -> str:
    return f"case when {PRESENT.format(column)} then try_cast(case when regexp_full_match(replace({column}, ',', ''), '\\s*[+-]?[0-9]+\\s*') then replace({column}, ',', '') end as bigint) end"


def as_float(column: str) -> str:
    return f"case when {PRESENT.format(column)} and regexp_matches({column}, '^[0-9.]+$') then try_cast({column} as double) end"


def as_minutes(column: str) -> str:
    def found(pattern: str) -> str:
        return f"try_cast(nullif(regexp_extract(lower({column}), '{pattern}', 1), '') as bigint)"

    total = f"(coalesce({found('([0-9]+)\\s*h')}, 0) * 60 + coalesce({found('([0-9]+)\\s*m')}, 0))"
    return f"case when {PRESENT.format(column)} then case when {total} <> 0 then {total} else {found('([0-9]+)')} end end"


def as_text(column: str) -> str:
    return f"case when {PRESENT.format(column)} then {STRIP.format(column)} end"


ORACLES["delimited_scan"] = with_(TITLES, RAW, select='select tconst, "titleType", "startYear" from raw')
ORACLES["eligible_ids"] = with_(
    TITLES,
    RAW,
    select="""select tid from raw where "titleType" in ('movie', 'tvMovie') and "startYear" >= 1970
       and "numVotes" >= 2500 and "averageRating" >= 1.0""",
)
ORACLES["tid_text_id"] = """
select distinct tid, 'tt' || case when length(tid::varchar) >= 7 then tid::varchar else lpad(tid::varchar, 7, '0') end as text_id,
  tid as back from (select l_orderkey::bigint * 1009 as tid from lineitem)"""

ODD = f"""
odd as (select (conv_id * 1000 + turn)::bigint as qid,
         case when (conv_id * 1000 + turn) % 5 = 0 then ' ' || chr(9) when (conv_id * 1000 + turn) % 11 = 0 then null else text end as query,
         {pick(["tt0000012", "xx", "tt", "", "tt12345678", "tt1x", "tt0000007"], "conv_id * 1000 + turn")} as item_id,
         ((conv_id * 1000 + turn) % 9 - 2)::int as max_results,
         ((conv_id * 1000 + turn) % 13 - 1)::double as min_rating,
         {pick([*PRESETS, "other", ""], "conv_id * 1000 + turn")} as preset,
         case (conv_id * 1000 + turn) % 4 when 1 then 0.33::double when 2 then 0.0::double end as genre_weight,
         case when (conv_id * 1000 + turn) % 6 = 0 then 1975 end as year_from,
         case when (conv_id * 1000 + turn) % 10 = 0 then 1999 end as year_to,
         (conv_id * 1000 + turn) % 2 = 0 as use_cultural_weights from conversations)"""
TEXT_KEY = "case when regexp_full_match(substr(item_id, 3), '[0-9]+') then substr(item_id, 3)::bigint end"

ORACLES["text_id_quarantine"] = with_(ODD, select=f"select qid, item_id, {TEXT_KEY} as tid from odd")
ORACLES["first_ids"] = with_(TITLES, RAW, select="select tid from raw order by tid limit 25")

GOOD = "tid % 13 <> 0 and tid % 17 <> 0"
ORACLES["payload_parse"] = with_(
    TITLES,
    LOOSE,
    select=f"""select tid, {as_text("title_text")} as title, {as_int("year_text")} as year, {as_text("rated_text")} as rated,
       {as_minutes("runtime_text")} as runtime, array_to_string({as_list("genre_text", ",")}, '|') as genre,
       array_to_string({as_list("director_text", ",")}, '|') as director, array_to_string({as_list("actors_text", ",")}, '|') as actors,
       array_to_string({as_list("language_text", ",")}, '|') as language, array_to_string({as_list("country_text", ",")}, '|') as country,
       array_to_string({as_list("awards_text", "&")}, '|') as awards,
       md5({as_text("plot")}) as plot_md5, {fixed(as_float("rating_text"))} as rating, {as_int("votes_text")} as votes,
       {as_int("metascore_text")} as metascore, {as_text("poster_text")} as poster
       from loose where {GOOD}""",
)
ORACLES["payload_quarantine"] = with_(
    TITLES,
    LOOSE,
    select=f"""select tid, case when tid % 17 = 0 then 'malformed payload' when tid % 26 = 0 then 'Incorrect id.'
       else 'Unknown error' end as error from loose where not ({GOOD})""",
)
ORACLES["split_field"] = with_(
    TITLES, LOOSE, select=f"select tid, array_to_string({as_list('genre_text', ',')}, '|') as parts from loose"
)
ORACLES["awards_split"] = with_(
    TITLES, LOOSE, select=f"select tid, array_to_string({as_list('awards_text', '&')}, '|') as parts from loose"
)
ORACLES["parse_int"] = with_(
    TITLES,
    LOOSE,
    select=f"""select tid, {as_int("votes_text")} as votes, {as_int("year_text")} as year,
       {as_int("rating_text")} as not_int from loose""",
)
ORACLES["parse_float"] = with_(TITLES, LOOSE, select=f"select tid, {as_float('rating_text')} as rating from loose")
ORACLES["parse_duration"] = with_(TITLES, LOOSE, select=f"select tid, {as_minutes('runtime_text')} as minutes from loose")
ORACLES["parse_string"] = with_(TITLES, LOOSE, select=f"select tid, {as_text('title_text')} as title from loose")
ORACLES["list_field"] = with_(
    TITLES,
    select="""select tid, coalesce(array_to_string(country, '|'), '') as from_array,
       coalesce(array_to_string(country, '|'), '') as from_text from titles""",
)
ORACLES["searchable_titles"] = with_(TITLES, select="select tid, title from titles where plot <> ''")
ORACLES["encodable_counts"] = with_(
    TITLES, select="select count(plot) as with_plot, count(genre) as with_genre from titles"
)

ORACLES["encoding_report"] = with_(
    TITLES,
    "held as (select count(plot) as plots, count(genre) as genres from titles)",
    select="""select 'titles' as source, 'plot' as field, plots as n, case when plots = 0 then 'no titles with a plot' end as error from held
       union all select 'titles', 'genre', genres, case when genres = 0 then 'no titles with a genre' end from held
       union all select 'unplotted', 'plot', 0, 'no titles with a plot'
       union all select 'unplotted', 'genre', genres, case when genres = 0 then 'no titles with a genre' end from held
       union all select 'keyless', 'tid', null, 'missing required column: tid'
       union all select 'keyless', 'plot', plots, case when plots = 0 then 'no titles with a plot' end from held
       union all select 'bare', 'tid', null, 'missing required column: tid'
       union all select 'bare', 'plot, genre', null, 'at least one of the columns plot and genre is required'""",
)

# --- ratings and scaling ---------------------------------------------------------------------------------------------

ORACLES["rating_means"] = with_(
    TITLES,
    FUSED,
    select=f"select {fixed('mv')} as mean_votes, {fixed('mr')} as mean_rating, {fixed('mm')} as mean_metascore from means",
)
ORACLES["rating_fusion"] = with_(
    TITLES,
    FUSED,
    select=f"""select tid, {fixed("v")} as votes, {fixed("nr")} as n_rating, {fixed("nm")} as n_metascore,
       {fixed("bayes")} as bayes_rating, {fixed("final")} as final_rating from fused""",
)
ORACLES["controversy"] = with_(TITLES, FUSED, select=f"select tid, {fixed('heat')} as controversy_score from fused")
ORACLES["mean_final_rating"] = with_(TITLES, FUSED, select=f"select {fixed('avg(final)')} as mean_final_rating from fused")


def min_max(column: str) -> str:
    low, high = f"(min({column}) over ())::double", f"(max({column}) over ())::double"
    return f"({column}::double - {low}) / ({high} - {low})"


ORACLES["scalar_norm"] = with_(
    TITLES,
    select="select tid, "
    + ", ".join(f"{fixed(min_max(c))} as sn_{c}" for c in ("year", "runtime", "rating", "votes", "metascore"))
    + " from titles",
)
ORACLES["scalar_norm_const"] = with_(
    TITLES,
    select=f"""select tid, 0.5::double as sn_same, 0.5::double as sn_nothing, {fixed(min_max("votes"))} as sn_votes
       from titles""",
)
ORACLES["top_titles"] = with_(
    TITLES,
    FUSED,
    select=f"""select tid, title, year, score, place::int as place from (select *, row_number() over (partition by year
       order by score desc, tid) as place from (select tid, title, year, {fixed("final")} as score from fused))
       where place <= 10""",
)

# --- vocabularies and features ---------------------------------------------------------------------------------------

for kind, name in (("country", "cv"), ("language", "lv"), ("genre", "gv")):
    ORACLES[f"vocab_{kind}"] = with_(
        TITLES, features(), select=f"select val as value, idx::int as idx from {name}"
    )
ORACLES["vocab_words"] = f"""
select value, (row_number() over (order by value) - 1)::int as idx from (
  select distinct {STRIP.format("piece")} as value from (select unnest(regexp_split_to_array(text, '\\s+')) as piece from documents)
  where {STRIP.format("piece")} <> '')"""
ORACLES["feature_combos"] = with_(
    TITLES, features(), select=f"select {COMBO} as combo, count(*) as members from la group by a"
)
ORACLES["feature_combos_by_join"] = ORACLES["feature_combos"]
ORACLES["multi_hot_genre"] = with_(
    TITLES, features(), select="select tid, unnest(a)::int as pos, 1.0::double as value from ga"
)
ORACLES["pad_truncate"] = f"""
select tid, pos, value from (select vec_id::bigint as tid, (pos - 1)::int as pos, {fixed("embedding[pos]::double")} as value
  from embeddings cross join (select unnest(range(1, 65)) as pos) where embedding[pos] <> 0
  union all select vec_id, (pos + 69)::int, {fixed("embedding[pos]::double")} from embeddings
  cross join (select unnest(range(1, 6)) as pos) where embedding[pos] <> 0
  union all select vec_id, -1, 75.0 from embeddings)"""

UNIT = """
units as (select vec_id::bigint as tid, label, list_transform(embedding, lambda x: x::double
         / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings)"""


def spread(source: str, vector: str, dim: int, key: str = "tid") -> str:
    """Non-zero entries of a list column."""
    return f"""select {key}, pos::int as pos, {fixed(f"{vector}[pos + 1]::double")} as value
       from {source} cross join (select unnest(range({dim})) as pos) where {vector}[pos + 1] <> 0"""


ORACLES["l2_normalize"] = with_(UNIT, select=spread("units", "u", 64))
ORACLES["join_encode"] = with_(
    UNIT, select=spread("(select units.* from units join documents on doc_id = tid)", "u", 64)
)
ORACLES["genre_vectors"] = with_(
    TITLES,
    features(),
    select=f"""select tid, pos::int as pos, {fixed("1 / sqrt(len(a))")} as value from (
       select tid, a, unnest(a) as pos from ga)""",
)
ORACLES["full_join_embeddings"] = with_(
    TITLES,
    select="""select coalesce(tid, vec_id)::bigint as tid, vec_id is not null as has_plot, tid is not null as has_genre
       from embeddings full join (select tid from titles) on tid = vec_id""",
)
ORACLES["merge_weighted"] = with_(
    TITLES,
    features(),
    UNIT,
    """
whole as (select tid, list_concat(list_transform(u, lambda x: x * (0.7 / 1.2)::double), list_transform(range(32),
         lambda i: case when list_contains(a, i) then (0.5 / 1.2)::double / sqrt(len(a)) else 0 end)) as w from units join ga using (tid)),
merged as (select tid, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) as m from whole)""",
    select=spread("merged", "m", 96),
)
ORACLES["popularity_boost"] = with_(
    TITLES, FUSED, BOUNDS, POPULAR.format(source="scaled"), select=f"select tid, {fixed('pop')} as pop from popular"
)
ORACLES["popularity_uniform"] = "select p_partkey::bigint as tid, 1.0::double as pop from part"
ORACLES["loc_vector_128"] = with_(
    TITLES,
    features(),
    select=f"""select tid, pos::int as pos, {fixed("value")} as value from (select tid, pos, {wide_loc("a", "pos")} as value
       from la cross join (select unnest(range(128)) as pos)) where value <> 0""",
)
ORACLES["loc_vector_small"] = with_(
    TITLES,
    features(),
    select=f"""select tid, pos::int as pos, {fixed("value")} as value from (select tid, pos, {byte(f"md5({LISTED})", "pos")} * 0.7 as value
       from la cross join (select unnest(range(16)) as pos) where len(a) > 0) where value <> 0""",
)
ORACLES["subcluster_plan"] = with_(
    TITLES,
    features(),
    select=f"""select {COMBO} as combo, count(*) as members, (case when count(*) <= 1 then 1 else least(count(*),
       greatest(2, count(*) // 5), greatest(1, 32 - (select count(*) from gv))) end)::int as k
       from ga join embeddings on vec_id = tid group by a""",
)
ORACLES["grouped_kmeans_plan"] = with_(
    TITLES,
    features(),
    select=f"""select * from (select {COMBO} as combo, count(*) as members, (case when count(*) <= 1 then 1 else least(count(*),
       greatest(2, count(*) // 5), greatest(1, 128 - (select count(*) from gv))) end)::int as k, true as in_range
       from ga join embeddings on vec_id = tid group by a) where k > 1""",
)
GENRE_GROUPS = """
ks as (select ga.tid, a, embedding::double[] as v, count(*) over (partition by a) as n, dense_rank() over (order by a) as gid
         from ga join embeddings on vec_id = ga.tid)"""
ORACLES["grouped_kmeans"] = with_(
    TITLES,
    features(),
    GENRE_GROUPS,
    kmeans(
        f"select * from (select gid, tid, v, {clusters('n', 5, '128 - (select count(*) from gv)')} as k from ks) where k > 1", "km"
    ),
    select=f"select km.tid, {COMBO} as combo, cluster, k, {fixed('distance')} as distance from km join ks using (gid, tid)",
)
ORACLES["plot_kmeans"] = with_(
    TITLES,
    kmeans("select 0 as gid, tid, embedding::double[] as v, 16 as k from embeddings join titles on vec_id = tid", "km"),
    select="select titles.tid, coalesce(cluster, 0)::int as label from titles left join km using (tid)",
)
ORACLES["cluster_signature"] = with_(
    TITLES,
    features(),
    f"""
signed as (select ga.tid, label, ga.a as g, la.a as l, (select count(*) from gv) as size,
         md5(md5({COMBO.replace("(a", "(ga.a")}) || '_' || label) as gh, md5(md5({COMBO.replace("(a", "(la.a")}) || '_' || label) as lh
         from ga join la on la.tid = ga.tid join embeddings on vec_id = ga.tid),
points as (select tid, pos, case
         when pos < 32 and pos < size then case when list_contains(g, pos) then 1.0::double else 0 end
         when pos < 32 and pos < size + 8 then {byte("gh", "pos - size")} * 0.5
         when pos < 32 then 0
         when pos < 144 then {wide_loc("l", "pos - 32")}
         when pos = 144 then label / 9.0::double * 0.3
         else {byte("lh", "pos - 145")} * (0.2::double / 10) end as value
         from signed cross join (select unnest(range(160)) as pos))""",
    select=f"select tid, pos::int as pos, {fixed('value')} as value from points where value <> 0",
)
ORACLES["hash_encode"] = with_(
    hashed("documents", "doc_id", "text", "hv"), select=spread("hv", "p", 64, "doc_id")
)
ORACLES["genre_diversity"] = with_(
    TITLES,
    """
sized as (select tid, len(list_distinct(genre)) as n, max(len(list_distinct(genre))) over () as top from titles)""",
    select="""select tid, (case when top <= 1 then 0 when n < 1 then 0 else least(8, (n - 1) * 7 // (top - 1) + 1) end)::int
       as bucket from sized""",
)
ORACLES["genre_keywords"] = (
    "select conv_id, turn, array_to_string(list_filter(["
    + ", ".join(
        f"case when {' or '.join(f'contains(lower(text), {text(w)})' for w in words)} then {text(g)} end"
        for g, words in GENRE_KEYWORDS.items()
    )
    + "], lambda g: g is not null), '|') as genres from conversations"
)

# --- joins by key, stored tables and incremental jobs ----------------------------------------------------------------

ORACLES["semi_searchable"] = with_(
    TITLES,
    select="select vec_id::bigint as tid, label from embeddings where vec_id in (select tid from titles where plot <> '')",
)
ORACLES["anti_resume"] = with_(
    TITLES,
    LOOSE,
    select=f"select tid, {as_text('title_text')} as title, {as_int('votes_text')} as votes from loose where {GOOD}",
)
ORACLES["versioned_table"] = with_(TITLES, select="select tid, votes, votes > 0 as kept from titles")
ORACLES["resume_union"] = with_(
    TITLES,
    select="""select vec_id::bigint as tid, label from embeddings union all
       select tid, -1 from titles where tid not in (select vec_id from embeddings)""",
)
REJECTED = f"""select tid, case when tid % 17 = 0 then 'malformed payload' when tid % 26 = 0 then 'Incorrect id.'
       else 'Unknown error' end as error from loose where not ({GOOD})"""
ORACLES["incremental_ingest"] = with_(
    TITLES,
    LOOSE,
    select=f"""select tid, {as_text("title_text")} as title, {as_int("votes_text")} as votes, null as error from loose where {GOOD}
       union all select tid, null, null, error from ({REJECTED})""",
)
PLOT_VECTORS = hashed("titles", "tid", "plot", "hv", "passage: ")
ORACLES["resume_embedding"] = with_(TITLES, PLOT_VECTORS, select=spread("hv", "p", 64))
ORACLES["incremental_encode"] = with_(
    hashed("(select doc_id as tid, text from documents)", "tid", "text", "hv", "passage: "), select=spread("hv", "p", 64)
)

# --- components ------------------------------------------------------------------------------------------------------

CATALOGUE = ",\n".join(
    [
        TITLES,
        FUSED,
        """
lows as (select min(v) as lo, max(v) as hi from fused),
films as (select fused.*, (v - lo) / (hi - lo) as sn_votes from fused cross join lows where plot <> '')""",
        POPULAR.format(source="films"),
        features("films"),
        hashed("films", "tid", "plot", "hv", "passage: "),
        f"""
lraw as (select tid, list_transform(range(128), lambda i: {wide_loc("a", "i")}) as w from la),
items as (select popular.tid, list_transform(p, lambda x: x::float) as p,
         list_transform(range(32), lambda i: case when list_contains(ga.a, i) then 1 / sqrt(len(list_filter(ga.a, lambda f: f < 32)))
           else 0 end::float) as g,
         list_transform(w, lambda x: (x / greatest(sqrt(list_dot_product(w, w)), 1e-12))::float) as l, pop as o
         from popular join hv using (tid) join ga using (tid) join lraw using (tid))""",
    ]
)
ORACLES["components"] = with_(
    CATALOGUE,
    "stacked as (select tid, list_concat(p, g, l, [o::float]) as v from items)",
    select=spread("stacked", "v", 225),
)
BUILT = f"""
titles as (select tid, {as_text("title_text")} as title, {as_list("genre_text", ",")} as genre, {as_list("country_text", ",")} as country,
         {as_list("language_text", ",")} as language, {as_text("plot")} as plot, {as_float("rating_text")} as rating,
         {as_int("votes_text")} as votes, {as_int("metascore_text")} as metascore
         from loose where {GOOD} and tid in (select tid from raw where "titleType" in ('movie', 'tvMovie') and "startYear" >= 1970
           and "numVotes" >= 2500 and "averageRating" >= 1.0))"""
GENRES_OF = "(select distinct unnest(genre) as val from {})"
ORACLES["build_catalogue"] = with_(
    TITLES.replace("titles as", "given as"),
    RAW.replace("from titles)", "from given)"),
    LOOSE.replace("from titles)", "from given)"),
    BUILT,
    CATALOGUE.removeprefix(TITLES + ",\n").replace(GENRES_OF.format("films"), GENRES_OF.format("fused")),  # genres of all rated titles
    "stacked as (select tid, list_concat(p, g, l, [o::float]) as v from items)",
    select=spread("stacked", "v", 225),
)
PLAIN_LOC = f"""
lraw as (select tid, list_transform(range(128), lambda i: {wide_loc("a", "i")}) as w from la),"""
PLAIN_GENRE = """list_transform(range(32), lambda i: case when list_contains(ga.a, i) then 1 / sqrt(len(list_filter(ga.a, lambda f: f < 32)))
           else 0 end::float) as g"""


def sub_clusters(active: str, out: str, per_cluster: int, room: str) -> str:
    """``{out}(tid, cluster, k, digest)`` of the titles whose combination is clustered by plot."""
    grouped = f"select * from (select gid, tid, v, {clusters('n', per_cluster, room)} as k from {out}_groups) where k > 1"
    return f"""
{out}_groups as (select tid, a, p as v, count(*) over (partition by a) as n, dense_rank() over (order by a) as gid
         from {active} join hv using (tid)),
{kmeans(grouped, out + "_km").strip()},
{out} as (select tid, cluster, k, md5(md5({COMBO}) || '_' || cluster) as digest from {out}_km join {out}_groups using (gid, tid))"""


TAILS = ",".join(
    [
        sub_clusters("la", "lt", 3, "128 - (select count(*) from cv) - (select count(*) from lv)"),
        sub_clusters("ga", "gt", 5, "32 - (select count(*) from gv)"),
        f"""
lraw as (select la.tid, list_transform(range(128), lambda i: case when cluster is null or i < 112 then {wide_loc("a", "i")}
         when i = 112 then cluster / (k - 1.0::double) * 0.3 else {byte("digest", "i - 113")} * (0.2::double / k) end) as w
         from la left join lt using (tid)),
graw as (select tid, list_transform(range(32), lambda i: case when i < size then list_contains(a, i)::int::double
         when cluster is not null and i < size + 8 then {byte("digest", "i - size")} * 0.5 else 0 end) as gw
         from (select tid, a, cluster, digest, (select count(*) from gv) as size from ga left join gt using (tid))),""",
    ]
)
UNIT_GENRE = "list_transform(gw, lambda x: (x / greatest(sqrt(list_dot_product(gw, gw)), 1e-12))::float) as g"
CLUSTERED = CATALOGUE.replace(PLAIN_LOC, TAILS).replace(PLAIN_GENRE, UNIT_GENRE).replace("join lraw using (tid)", "join lraw using (tid) join graw using (tid)")
ORACLES["clustered_components"] = with_(
    CLUSTERED,
    "stacked as (select tid, list_concat(p, g, l, [o::float]) as v from items)",
    select=spread("stacked", "v", 225),
)
ORACLES["component_quality"] = with_(
    CATALOGUE,
    select="select count(*) as titles, (select count(*) from items) as components, 0::bigint as missing from films",
)
ORACLES["model_store"] = with_(
    CATALOGUE,
    select="""select kind, val as value, idx::int as idx, 64 as plot_dim, 32 as genre_dim, 128 as loc_dim from (
       select 'country' as kind, * from cv union all select 'language', * from lv union all select 'genre', * from gv)""",
)
ORACLES["combined_embedding"] = with_(
    CATALOGUE,
    """
weighed as (select tid, list_concat(list_transform(p, lambda x: x::double * 0.5), list_transform(g, lambda x: x::double * 0.25),
         list_transform(l, lambda x: x::double * 0.05), [o * 0.2]) as w from items),
combined as (select tid, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) as c from weighed)""",
    select=spread("combined", "c", 225),
)
ORACLES["catalog_stats"] = with_(
    CATALOGUE,
    select=f"""select count(*) as total_titles, min(year) as year_min, max(year) as year_max, {fixed("avg(rating)")} as avg_rating,
       (select count(*) from cv) as total_countries, (select count(*) from lv) as total_languages, 225 as embedding_dimension,
       count(*) as index_size from films""",
)

# --- requests --------------------------------------------------------------------------------------------------------


def weight(name: str, default: float, own: str | None, preset: str = "preset") -> str:
    cases = " ".join(f"when {text(p)} then {getattr(w, name)}" for p, w in PRESETS.items())
    base = f"case lower(coalesce({preset}, '')) when '' then {default} {cases} else {DEFAULT[name]} end::double"
    return f"coalesce(case when {own} > 0 then {own} end, {base})" if own else base


DEFAULT = {"plot": 0.5, "genre": 0.25, "localization": 0.1, "popularity": 0.15}
ITEM_DEFAULT = {"plot": 0.44, "genre": 0.13, "localization": 0.1, "popularity": 0.33}
SHORT = {"plot": "wp", "genre": "wg", "localization": "wl", "popularity": "wo"}

BENCH_ROWS = f"""
bench as (select item_id::bigint as qid, text as query,
         case when item_id % 4 <> 0 then ['NATION_' || (item_id % 30), 'NATION_7'] end as countries,
         case when item_id % 3 <> 0 then ['ASIA', 'Klingon'] end as languages,
         case when item_id % 5 = 0 then 20 else item_id % 5 * 15 end as m,
         case when item_id % 3 = 0 then 0.5::double end as min_rating,
         case when item_id % 4 = 1 then 20 end as min_votes,
         case when item_id % 5 = 2 then 1980 when item_id % 7 = 3 then 1900 end as y0,
         case when item_id % 7 = 3 then 1990 when item_id % 5 = 2 then 2030 end as y1,
         {pick([*PRESETS, ""], "item_id")} as preset,
         case when item_id % 6 = 1 then 0.9::double end as plot_weight,
         case when item_id % 6 = 2 then 0.0::double end as popularity_weight from benchmark)"""
BENCH = f"""{BENCH_ROWS},
asked as (select *, m as k, {weight("plot", 0.5, "plot_weight")} as wp, {weight("genre", 0.25, None)} as wg,
         {weight("localization", 0.1, None)} as wl, {weight("popularity", 0.15, "popularity_weight")} as wo from bench)"""

# ``asked``: qid, query, countries, languages, k, wp, wg, wl, wo
QUERY_VECTORS = ",\n".join(
    [
        hashed("asked", "qid", "query", "qv", "passage: "),
        f"""
wanted as (select qid, case when len(coalesce(countries, [])) + len(coalesce(languages, [])) = 0
           then ['USA', 'United States', 'UK', 'United Kingdom'] else coalesce(countries, []) end as c,
         case when len(coalesce(countries, [])) + len(coalesce(languages, [])) = 0 then ['English'] else coalesce(languages, []) end as l
         from asked),
known as (select qid, idx as f from (select qid, unnest(c) as val from wanted) join cv using (val) union all
         select qid, idx + (select count(*) from cv) from (select qid, unnest(l) as val from wanted) join lv using (val)),
qa as (select asked.qid, coalesce(list_sort(list(distinct f) filter (f is not null)), []::bigint[]) as a
         from asked left join known using (qid) group by asked.qid),
ql as (select qid, list_transform(range(128), lambda i: {wide_loc("a", "i")}) as l from qa),
near as (select qid, tid, row_number() over (partition by qid order by sim desc, tid) as place, sim from (
         select qid, tid, round(list_dot_product(qv.p, items.p::double[]) / sqrt(list_dot_product(qv.p, qv.p))
           / sqrt(list_dot_product(items.p::double[], items.p::double[])), 9) as sim from qv cross join items)),
qgp as (select qid, pos, sum(exp(3 * sim) * g[pos + 1]::double) / sum(exp(3 * sim)) as value
         from near join items using (tid) cross join (select unnest(range(32)) as pos) where place <= 20 group by qid, pos),
qg as (select qid, list(value order by pos) as g from qgp group by qid)""",
    ]
)

RANKED = """
qall as (select asked.qid, k, wp * wp as p2, wg * wg as g2, wl * wl as l2, wo * wo as o2, qv.p, qg.g, ql.l,
         list_dot_product(qv.p, qv.p) as pn, list_dot_product(qg.g, qg.g) as gn, list_dot_product(ql.l, ql.l) as ln
         from asked join qv using (qid) join qg using (qid) join ql using (qid)),
inorm as (select tid, p::double[] as ip, g::double[] as ig, l::double[] as il, o,
         list_dot_product(p::double[], p::double[]) as ipn, list_dot_product(g::double[], g::double[]) as ign,
         list_dot_product(l::double[], l::double[]) as iln from items),
scores as (select qid, tid, k, round((p2 * list_dot_product(p, ip) + g2 * list_dot_product(g, ig) + l2 * list_dot_product(l, il)
         + o2 * 1.5 * o) / (sqrt(p2 * ipn + g2 * ign + l2 * iln + o2 * o * o) * sqrt(p2 * pn + g2 * gn + l2 * ln + o2 * 2.25)), 9)
         as sim from qall cross join inorm),
ranked as (select * from (select *, row_number() over (partition by qid order by sim desc, tid) as rank from scores)
         where rank <= k)"""


def searched(asked: str, *more: str, select: str) -> str:
    return with_(CATALOGUE, asked, QUERY_VECTORS, RANKED, *more, select=select)


HIT = f"qid, rank, tid, {fixed('sim')} as similarity"

ORACLES["query_loc_vector"] = with_(CATALOGUE, BENCH, QUERY_VECTORS, select=spread("ql", "l", 128, "qid"))
ORACLES["query_genre_vector"] = with_(CATALOGUE, BENCH, QUERY_VECTORS, select=spread("qg", "g", 32, "qid"))

MATCH = "coalesce(list_has_any(country, countries), false) as cultural_match"
LOW_LEVEL = """
asked as (select *, 10 as k, 0.5::double as wp, 0.25::double as wg, 0.05::double as wl, 0.2::double as wo from bench)"""
ORACLES["weighted_search"] = searched(
    BENCH_ROWS + "," + LOW_LEVEL,
    select=f"select {HIT}, {MATCH} from ranked join films using (tid) join asked using (qid)",
)

FILTERED = """
kept as (select scores.qid, scores.tid, sim, countries, m, row_number() over (partition by qid order by sim desc, tid) as rank
         from scores join films using (tid) join asked using (qid)
         where (min_rating is null or final >= min_rating) and (min_votes is null or v >= min_votes)
         and (y0 is null or year between y0 and y1)),
found as (select * from kept where rank <= m)"""
ORACLES["search_filtered"] = searched(
    BENCH, FILTERED, select=f"select {HIT}, {MATCH} from found join films using (tid)"
)
ORACLES["clustered_search"] = with_(
    CLUSTERED, BENCH, QUERY_VECTORS, RANKED, FILTERED, select=f"select {HIT} from found join films using (tid)"
)
ORACLES["search_records"] = searched(
    BENCH,
    FILTERED,
    select=f"""select {HIT}, 'tt' || lpad(tid::varchar, 7, '0') as imdb_id, title, coalesce(year, 0) as year, {fixed("final")} as rating,
       coalesce(v, 0)::bigint as votes, {fixed("coalesce(sn_votes, 0)")} as popularity_score,
       coalesce(array_to_string(country, '|'), '') as countries, coalesce(array_to_string(language, '|'), '') as languages,
       array_to_string(genre, '|') as genres, md5(plot) as plot_md5, '' as poster from found join films using (tid)""",
)


def plain(source: str, m: int) -> str:
    return f"""
asked as (select qid, query, null::varchar[] as countries, null::varchar[] as languages, {m} as k, 0.5::double as wp,
         0.25::double as wg, 0.1::double as wl, 0.15::double as wo from ({source}))"""


ORACLES["batch_search"] = searched(
    plain("select (conv_id * 1000 + turn)::bigint as qid, text as query from conversations where trim(text) <> ''", 20),
    select=f"select {HIT} from ranked where rank <= 20",
)
ORACLES["search_simple"] = searched(
    plain("select item_id::bigint as qid, text as query from benchmark", 10),
    select=f"select {HIT} from ranked where rank <= 10",
)


def items(source: str) -> str:
    """Search requests made from the titles named by ``source(qid, tid, m, cultural)``."""
    weights = ", ".join(
        f"case when cultural then {ITEM_DEFAULT[n]} else {DEFAULT[n]} end::double as {short}" for n, short in SHORT.items()
    )
    return f"""
sources as ({source}),
asked as (select qid, tid as source, m, m + 1 as k,
         lower(array_to_string(genre, ' ')) || ' ' || coalesce(plot, '') as query,
         case when cultural then country end as countries, case when cultural then language end as languages, {weights}
         from sources join films using (tid))"""


OTHERS = """
others as (select *, row_number() over (partition by qid order by rank) as place from (
         select ranked.*, source, m from ranked join asked using (qid) where rank <= m + 1) where tid <> source)"""
LABELLED = """select doc_id as qid, doc_id as tid, case when toxic = 1 then 5 else 10 end as m, quality = 1 as cultural from labels"""
ORACLES["recommend"] = searched(items(LABELLED), OTHERS, select=f"select {HIT} from others where place <= m")
ORACLES["recommend_status"] = searched(
    items(LABELLED),
    OTHERS,
    select="select doc_id as qid, case when doc_id in (select qid from others where place <= m) then 0 else 3 end as error_code from labels",
)
NAMED = """select qid, min(tid) as tid from (select min(p_partkey)::bigint as qid, p_name from part group by p_name)
         join films on contains(lower(title), lower(p_name)) group by qid"""
ORACLES["title_lookup"] = with_(CATALOGUE, select=NAMED)
ORACLES["title_fragments"] = with_(
    CATALOGUE,
    select="""select qid, min(tid) as tid from (select p_partkey::bigint as qid, substr(lower(p_name), (1 + p_partkey % 7)::bigint, (p_partkey % 9)::bigint) as piece
              from part) join films on contains(lower(title), piece) group by qid""",
)
ORACLES["title_fragments_by_join"] = ORACLES["title_fragments"]
ORACLES["recommend_by_title"] = searched(
    items(f"select qid, tid, 10 as m, true as cultural from ({NAMED})"), OTHERS, select=f"select {HIT} from others where place <= m"
)
SETTINGS = ", ".join(
    f"({i}, {text(n)}, {w.plot}::double, {w.genre}::double, {w.localization}::double, {w.popularity}::double)"
    for i, (n, w) in enumerate(SWEEP.items())
)
ORACLES["weight_sweep"] = searched(
    f"""
settings(number, setting, wp, wg, wl, wo) as (values {SETTINGS}),
asked as (select item_id::bigint * 4 + number as qid, item_id::bigint as base, setting, text as query,
         case when item_id % 4 <> 0 then ['NATION_' || (item_id % 30), 'NATION_7'] end as countries,
         case when item_id % 3 <> 0 then ['ASIA', 'Klingon'] end as languages, 10 as k, wp, wg, wl, wo
         from benchmark cross join settings)""",
    select="""select base as qid, setting, sum(coalesce(list_has_any(country, countries), false)::int)::bigint as matches,
       count(*) as results from ranked join films using (tid) join asked using (qid) group by all""",
)

SEARCH_ERROR = """case when coalesce(trim(query, ' ' || chr(9)), '') = '' then 1 when max_results < 0 then 4
       when min_rating < 0 or min_rating > 10 then 4 else 0 end"""
ITEM_ERROR = f"case when trim(item_id) = '' or ({TEXT_KEY}) is null then 2 when max_results < 0 then 4 else 0 end"


def odd_weights(defaults: dict[str, float]) -> dict[str, str]:
    return {n: weight(n, d, "genre_weight" if n == "genre" else None) for n, d in defaults.items()}


ORACLES["resolve_requests"] = with_(
    ODD,
    select="select qid, "
    + SEARCH_ERROR
    + " as error_code, "
    + ", ".join(f"{fixed(w)} as {n}_weight" for n, w in odd_weights(DEFAULT).items())
    + """, case when max_results > 0 then max_results else 20 end as max_results, case when min_rating > 0 then min_rating end as min_rating,
       case when year_from is not null or year_to is not null then coalesce(year_from, 1900) end as year_from,
       case when year_from is not null or year_to is not null then coalesce(year_to, 2030) end as year_to,
       (case when max_results > 0 then max_results else 20 end)::int as k from odd""",
)
ORACLES["resolve_recommendations"] = with_(
    ODD,
    select="select qid, "
    + ITEM_ERROR
    + f" as error_code, {TEXT_KEY} as source, "
    + ", ".join(
        f"{fixed(f'case when use_cultural_weights then {w} else {DEFAULT[n]} end')} as {n}_weight"
        for n, w in odd_weights(ITEM_DEFAULT).items()
    )
    + ", case when max_results > 0 then max_results else 10 end as max_results, use_cultural_weights from odd",
)
ORACLES["validate_requests"] = with_(
    ODD,
    f"""
checked as (select *, {SEARCH_ERROR} as se, {ITEM_ERROR} as ie from odd)""",
    select="""select qid, 'search' as kind, se as error_code, case when se = 1 then 'Search query cannot be empty'
       when se = 4 and max_results < 0 then 'max_results cannot be negative'
       when se = 4 then 'min_rating must be between 0 and 10' end as error_message from checked union all
       select qid, 'recommend', ie, case when ie = 2 and item_id = '' then 'IMDb ID cannot be empty'
       when ie = 2 then 'Invalid IMDb ID format: ' || item_id when ie = 4 then 'max_results cannot be negative' end from checked""",
)
ORACLES["cultural_match"] = with_(
    TITLES,
    select="select tid, coalesce(list_has_any(country, ['NATION_1', 'NATION_12', 'Nowhere']), false) as match from titles",
)

# --- locale ----------------------------------------------------------------------------------------------------------


def rows(values) -> str:
    return ", ".join(f"({text(k)}, [{', '.join(text(v) for v in vs)}])" for k, vs in values)


USERS = f"""
users as (select user_id, case when user_id % 10 <> 9 then {pick(USER_COUNTRIES, "user_id")} end as country,
         case when user_id % 3 <> 2 then {pick(USER_CODES, "user_id")} end as code,
         case when user_id % 4 <> 3 then {pick(USER_REGIONS, "user_id")} end as region,
         {pick(USER_ZONES, "user_id")} as tz from (select distinct user_id from events)),
tongues(place, languages) as (values {rows((n, ls) for ns, ls in COUNTRY_LANGUAGES for n in ns)}),
regions(place, languages) as (values {rows(REGION_LANGUAGES)}),
zones(zone, zcountry, zcode) as (values {", ".join(f"({text(z)}, {text(c)}, {text(k)})" for z, c, k in TIMEZONE_COUNTRY)}),
zoned as (select user_id, region, case when coalesce(country, '') = '' then zcountry else country end as country,
         case when coalesce(country, '') = '' then zcode else code end as code from users left join zones on tz = zone),
settled as (select user_id, region, code, coalesce(country, 'United States') as country from zoned)"""


def spoken(source: str) -> str:
    return f"""
spoken as (select user_id, country, code, coalesce(c.languages, []) as cl, coalesce(k.languages, []) as kl,
         coalesce(r.languages, []) as rl from {source} left join tongues c on c.place = country
         left join tongues k on k.place = code left join regions r on r.place = region),
based as (select *, list_concat(cl, list_filter(kl, lambda x: not list_contains(cl, x))) as b from spoken)"""


LANGUAGES = "array_to_string(list_concat(list_reverse(list_filter(rl, lambda x: not list_contains(b, x))), b), '|')"
ORACLES["locale_languages"] = with_(USERS, spoken("users"), select=f"select user_id, {LANGUAGES} as languages from based")
ORACLES["timezone_country"] = with_(USERS, select="select user_id, country, code from zoned")
ORACLES["locale_preferences"] = with_(
    USERS,
    spoken("settled"),
    select=f"""select user_id, country || case when code is not null and code <> country then '|' || code else '' end as countries,
       {LANGUAGES} as languages from based""",
)
