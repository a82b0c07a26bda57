"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import token_set_ratio
from ..operators import entities, evaluate, graph, reports, resolve, stats
from ..operators import text as texts
from ..session import checkpoint, table
from ..sources import files, html
from . import relations as R

Query = Callable[[SparkSession, str], DataFrame]
YEARS = list(range(2018, 2026))
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- SQL of the relations -------------------------------------------------------------------------------
_FIELD_ORDER = "fonte nulls first, ano nulls first, titulo nulls first, data_str nulls first, tipo nulls first"
TR = f"tr as (select doc_id, fonte, ano, titulo, data_str, tipo, text from (select *, row_number() over (partition by doc_id order by captured_at nulls first, {_FIELD_ORDER}, text) as r from transcript where text is not null) where r = 1)"
SE = f"se as (select doc_id, fonte, ano, titulo, tipo from (select *, row_number() over (partition by doc_id order by captured_at nulls first, {_FIELD_ORDER}) as r from transcript) where r = 1)"
CO = f"{SE}, co as (select fonte, tipo, ano, count(*) as contador from se group by 1, 2, 3)"
TIDY = f"{CO}, ti as (select fonte, upper(trim(coalesce(tipo, 'Unknown'))) as tipo, ano, contador from co)"
PE = """pe as (select doc_id, start, "end", word, score, mention_id from (select *, row_number() over (partition by doc_id, start, "end" order by score desc nulls last, mention_id) as r from entity_mention where entity_group = 'PESSOA' and word is not null and start < "end") where r = 1)"""
AN = f"""{TR}, {PE},
sp as (select distinct pe.doc_id, replace(replace(word, '<', ''), '>', '') as name, start, "end" from pe join tr on tr.doc_id = pe.doc_id where start >= 0 and "end" <= length(text)),
pt as (select doc_id, start as pos, 1 as opens, name from sp union all select doc_id, "end", 0, name from sp),
pp as (select *, coalesce(lag(pos) over w, 0) as was, row_number() over w as k from pt window w as (partition by doc_id order by pos, opens, name)),
bo as (select pp.doc_id, string_agg(substr(text, was + 1, pos - was) || case when opens = 1 then '<PESSOA:' || name || '>' else '</PESSOA>' end, '' order by k) as head, max(pos) as last from pp join tr on tr.doc_id = pp.doc_id group by pp.doc_id),
an as (select tr.doc_id, case when bo.doc_id is null then text else head || substr(text, last + 1) end as annotated from tr left join bo on bo.doc_id = tr.doc_id)"""


def _speech_sql(col: str, tag: str) -> str:
    return f"string_split(regexp_replace({col}, '(?i)(^|[^\\pL\\pN_])({tag}[OA]\\s+SRA?\\.\\s+[A-Za-zÀ-ÖØ-öø-ÿ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


_STRIP = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
SPEECH = f"""{AN},
s1 as (select doc_id, list_filter(list_transform({_speech_sql('annotated', '(?:<PESSOA:[^>]+>)?')}, lambda x: {_STRIP}), lambda x: x <> '') as l from an),
s2 as (select doc_id, unnest(l) as speech, generate_subscripts(l, 1) - 1 as speech_no from s1),
s3 as (select split_part(doc_id, '/', 1) || '_' || split_part(doc_id, '/', 2) as graph_id, doc_id, speech_no, speech, regexp_extract_all(speech, '<PESSOA:([^>]+)>', 1) as names from s2),
s4 as (select graph_id, doc_id, speech_no, names[1] as speaker, names from s3 where len(names) > 0),
mr as (select graph_id, doc_id, speech_no, speaker, unnest(case when len(names) > 1 then names[2:] else [null] end) as mention, unnest(case when len(names) > 1 then range(0, len(names) - 1) else [null] end) as pos from s4)"""
ED = """m1 as (select graph_id, speech_id, word, coalesce(max(weight), 0) as w from speech_mention where speech_id is not null and word is not null and graph_id is not null group by 1, 2, 3),
m2 as (select graph_id, speech_id, first_value(word) over (partition by graph_id, speech_id order by w desc, word) as src, word as dst from m1),
ed as (select graph_id, src, dst, count(*) as weight from m2 where src <> dst group by 1, 2, 3),
ve as (select graph_id, src as vertex from ed union select graph_id, dst from ed)"""
NA = """ed as (select 'n' as graph_id, c_nationkey as src, s_nationkey as dst, count(*) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 2, 3),
ve as (select graph_id, src as vertex from ed union select graph_id, dst from ed),
me as (select 'n' as graph_id, n_nationkey as vertex, n_regionkey as community from nation)"""
DE = """de as (select ve.graph_id, ve.vertex, cast(coalesce(i.n, 0) as bigint) as in_degree, cast(coalesce(o.n, 0) as bigint) as out_degree, cast(coalesce(i.s, 0) as bigint) as in_strength, cast(coalesce(o.s, 0) as bigint) as out_strength from ve
left join (select graph_id, dst, count(*) as n, sum(weight) as s from ed group by 1, 2) i on i.graph_id = ve.graph_id and i.dst = ve.vertex
left join (select graph_id, src, count(*) as n, sum(weight) as s from ed group by 1, 2) o on o.graph_id = ve.graph_id and o.src = ve.vertex)"""
UN = "un as (select distinct graph_id, least(src, dst) as src, greatest(src, dst) as dst from ed where src <> dst)"
GO = """go as (select doc_id, manual_start as start, manual_end as "end", min(cmp_id) as gold_id, first(manual_canon order by cmp_id) as canon, first(manual_raw order by cmp_id) as raw from compare_outputs where manual_start is not null group by 1, 2, 3),
pr as (select doc_id, algo_start as start, algo_end as "end", min(cmp_id) as pred_id, first(algo_canon order by cmp_id) as p_canon, first(raw_text order by cmp_id) as p_raw from compare_outputs where algo_start is not null group by 1, 2, 3),
ma as (select * from (select go.doc_id, gold_id, canon, raw, go.start, go."end", pred_id, p_canon, p_raw, pr.start as p_start, pr."end" as p_end, row_number() over (partition by go.doc_id, gold_id order by pred_id) as r from go join pr on pr.doc_id = go.doc_id and greatest(go.start, pr.start) < least(go."end", pr."end")) where r = 1)"""
OU = f"""{GO}, gs as (select doc_id, canon, list(distinct raw) as raws from go group by 1, 2), ps as (select doc_id, p_canon, list(distinct p_raw) as raws from pr group by 1, 2),
x as (select ma.*, coalesce(lower(canon) = lower(p_canon), false) or coalesce(lower(canon) = lower(p_raw), false) or coalesce(lower(raw) = lower(p_canon), false) or coalesce(lower(raw) = lower(p_raw), false) as nm, coalesce(list_has_any(gs.raws, ps.raws), false) as cm from ma left join gs using (doc_id, canon) left join ps using (doc_id, p_canon)),
ou as (select doc_id, case when nm and cm then 'TP' else 'DM' end as outcome, case when not nm then 'name_mismatch' when not cm then 'concept_mismatch' end as reason, canon, raw, start, "end", p_canon, p_raw, p_start, p_end from x
union all select doc_id, 'FN', null, canon, raw, start, "end", null, null, null, null from go where not exists (select 1 from ma where ma.doc_id = go.doc_id and ma.gold_id = go.gold_id)
union all select doc_id, 'FP', null, null, null, null, null, p_canon, p_raw, start, "end" from pr where not exists (select 1 from ma where ma.doc_id = pr.doc_id and ma.pred_id = pr.pred_id))"""


# ---- reports --------------------------------------------------------------------------------------------
@query(f"with {CO} select * from co")
def session_count_by_type_year(spark: SparkSession, d: str) -> DataFrame:
    return reports.count_sessions(R.sessions(spark, d))


def _pivot_sql(agg: str) -> str:
    cols = ", ".join(f"coalesce({agg}(contador) filter (where ano = {y}), 0)::double as y{y}" for y in YEARS)
    return f"with {TIDY}, kn as (select * from ti where tipo <> 'UNKNOWN') select fonte, tipo, {cols} from kn group by 1, 2"


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    return reports.count_sessions(R.sessions(spark, d)).withColumn("tipo", reports.tidy_type(F.col("tipo")))


@query(_pivot_sql("avg"))
def session_pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    return reports.pivot_years(_tidy(spark, d).where("tipo <> 'UNKNOWN'"), YEARS)


@query(_pivot_sql("sum"))
def session_pivot_sum(spark: SparkSession, d: str) -> DataFrame:
    return reports.pivot_years(_tidy(spark, d).where("tipo <> 'UNKNOWN'"), YEARS, "sum")


@query(f"with {SE} select fonte, ano, count(*) as contador, case when fonte = 'senado' then null else tipo end as tipo from se group by 1, 2, 4")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    s = R.sessions(spark, d)
    plenary = s.where("fonte = 'senado'").groupBy("fonte", "ano").agg(F.count(F.lit(1)).alias("contador"))
    return reports.combine(reports.count_sessions(s.where("fonte <> 'senado'")), plenary)


@query(f"with {TIDY} select tipo, sum(contador)::bigint as total from ti group by 1 order by 2 desc, 1 limit 6")
def type_top6(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_types(_tidy(spark, d))


@query(f"with {TIDY}, tp as (select tipo from ti group by 1 order by sum(contador) desc, 1 limit 6) select coalesce(tp.tipo, 'OUTROS') as tipo_grouped, fonte, sum(contador)::bigint as total from ti left join tp on tp.tipo = ti.tipo group by 1, 2")
def type_cleanup_topk_recode(spark: SparkSession, d: str) -> DataFrame:
    return reports.sum_by(reports.recode_rest(_tidy(spark, d)), "tipo_grouped", "fonte")


@query(f"with {CO} select ano, fonte, sum(contador)::bigint as total from co group by 1, 2")
def sum_by_year_source(spark: SparkSession, d: str) -> DataFrame:
    return reports.sum_by(reports.count_sessions(R.sessions(spark, d)), "ano", "fonte")


# ---- pages and fields -----------------------------------------------------------------------------------
@query(f"with {TR} select doc_id, trim(coalesce(titulo, 'sem título')) as title, trim(coalesce(titulo, 'sem título')) as heading from tr")
def html_title_heading(spark: SparkSession, d: str) -> DataFrame:
    return html.page_fields(R.pages(spark, d), "doc_id", "html").select("doc_id", "title", "heading")


@query(f"with {TR} select doc_id, split_part(doc_id, '/', 3) as code, 2::bigint as n_bold from tr")
def html_href_code(spark: SparkSession, d: str) -> DataFrame:
    f = html.page_fields(R.pages(spark, d), "doc_id", "html")
    return f.select("doc_id", F.get("codes", F.lit(0)).alias("code"), F.size("bold").cast("bigint").alias("n_bold"))


@query(f"with {TR}, a as (select doc_id, regexp_extract(trim(coalesce(tipo, 'x')) || ' geral', '[^ ]+') as tipo, split_part(doc_id, '/', 3) as codigo from tr) select * from a where tipo not in ('Outros', 'SECRETARIA')")
def html_agenda_cells(spark: SparkSession, d: str) -> DataFrame:
    """Agenda of pages that also hold cells of kinds left out and without a category, stray end tags and a link outside."""
    return html.agenda(html.page_fields(R.pages(spark, d), "doc_id", "html"), "doc_id")


@query(f"with {TR} select doc_id, chr(10) || regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') as text from tr")
def html_bold_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Transcript text assembled from bold speakers and the spans of class ``fala``."""
    return html.assemble(html.page_fields(R.pages(spark, d), "doc_id", "html", speech="fala"), "doc_id")


@query(f"with {TR} select doc_id, 3::bigint as spans, 'Outros eventos' as first from tr")
def html_elements_by_class(spark: SparkSession, d: str) -> DataFrame:
    by_tag = html.select_texts(R.pages(spark, d), "doc_id", "html", "span").select("doc_id", F.size("texts").cast("bigint").alias("spans"))
    by_class = html.select_texts(R.pages(spark, d), "doc_id", "html", css="g-agenda__categoria").select("doc_id", F.get("texts", F.lit(0)).alias("first"))
    return by_tag.join(by_class, "doc_id")


@query(f"with {TR} select doc_id from tr where length(rtrim(concat(coalesce(titulo, 'sem título'), 'xsem categoria Outros eventos ver ', coalesce(tipo, 'x'), ' geral verO SR. PRESIDENTENota', text), chr(32) || chr(9) || chr(10) || chr(13))) > 300")
def page_has_notes_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose body holds notes."""
    return html.has_notes(html.page_fields(R.pages(spark, d), "doc_id", "html")).select("doc_id")


@query("select doc_id, coalesce(tipo, '') || codigo as value from transcript where text is null or trim(text) = ''")
def error_status_filter(spark: SparkSession, d: str) -> DataFrame:
    """The error list of the captures: type and code where the status is exactly 500."""
    return files.failed_lines(html.failed(R.captures(spark, d), "doc_id"), "doc_id")


@query("select ano, concat_ws(chr(10), tipo || ':', codigo::varchar) as value from (select distinct ano, tipo, codigo from transcript) where codigo is not null")
def code_list_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.code_lines(table(spark, d, "transcript").select("ano", "tipo", "codigo").distinct())


@query(f"with {TR} select doc_id, regexp_replace(split_part(text, chr(10), 1), '\\r$', '') as first_line, case when len(string_split(text, chr(10))) > 1 then (with z as (select regexp_replace(string_split(text, chr(10))[2], '^\\s+|\\s+$', '', 'g') as l) select substr(l, 1, greatest(length(l) - 1, 0)) from z) end as second_line from tr")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return R.transcripts(spark, d).select("doc_id", X.first_line(t).alias("first_line"), X.second_line_type(t).alias("second_line"))


@query(f"with {TR} select doc_id, nullif(regexp_extract(regexp_replace(titulo, '\\s+', ' ', 'g'), '- [0-9]+[ªº] - ([\\pL\\pN_]+)', 1), '') as kind from tr")
def type_of_title(spark: SparkSession, d: str) -> DataFrame:
    return R.transcripts(spark, d).select("doc_id", X.type_of_title(F.col("titulo")).alias("kind"))


@query("""with p as (select distinct replace(doc_id, '/', '_') as base from entity_mention), t as (select distinct replace(doc_id, '/', '_') as base, fonte from transcript where text is not null)
select p.base || '.grouped_entities.json' as path, p.base, case when t.base is null then 'skipped' else 'processed' end as status from p left join t on t.base = p.base""")
def entity_file_text(spark: SparkSession, d: str) -> DataFrame:
    """Entity files joined with the text of their document, named with or without an extension."""
    flat = F.replace("doc_id", F.lit("/"), F.lit("_"))
    entity_files = table(spark, d, "entity_mention").select(F.concat(flat, F.lit(".grouped_entities.json")).alias("path")).distinct()
    texts_ = R.transcripts(spark, d).select(F.concat(flat, F.when(F.col("fonte") == "camara", ".txt").otherwise("")).alias("file"), "text")
    return files.text_of_entities(entity_files, texts_).select("path", "base", "status")


@query("""with p as (select distinct doc_id from entity_mention), t as (select distinct doc_id from transcript where text is not null) select case when t.doc_id is null then 'skipped' else 'processed' end as status, count(*) as files from p left join t on t.doc_id = p.doc_id group by 1""")
def entity_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return files.status_counts(entity_file_text(spark, d))


@query(f"with {TR} select doc_id, substr(text, 1, 500) as preview from tr order by doc_id limit 20")
def preview_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.preview(R.transcripts(spark, d), "doc_id", "text")


@query(f"""with {TR} select doc_id, nullif(regexp_extract(substr(titulo, 21, 180), '(?:^|[^0-9A-Za-z_])(201[0-9]|202[0-5])(?:[^0-9A-Za-z_]|$)', 1), '') as year,
nullif(regexp_extract(titulo, 'Em (\\d{{1,2}}[ºª]? de [a-zA-Zç]+ de \\d{{4}})', 1), '') as phrase, nullif(trim(regexp_extract(titulo, '^\\d+[ªº] [^-]+ - (.+) - Em ', 1)), '') as kind from tr""")
def year_from_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("titulo")
    return R.transcripts(spark, d).select("doc_id", X.year_of(t).cast("string").alias("year"), X.date_phrase(t).alias("phrase"), X.ordinal_type(t).alias("kind"))


_MONTHS = ", ".join(f"'{m}'" for m in X.MONTHS)


@query(f"with {TR} select doc_id, try_strptime(regexp_extract(data_str, '(\\d{{4}})$', 1) || '-' || list_position([{_MONTHS}], regexp_extract(data_str, 'de (\\pL+) de', 1)) || '-' || regexp_extract(data_str, '^(\\d+)', 1), '%Y-%m-%d')::date::varchar as day from tr")
def date_from_phrase(spark: SparkSession, d: str) -> DataFrame:
    return R.transcripts(spark, d).select("doc_id", X.phrase_date(F.col("data_str")).cast("string").alias("day"))


# ---- text -----------------------------------------------------------------------------------------------
@query(f"""with {TR}, s1 as (select doc_id, list_filter(list_transform({_speech_sql('text', '')}, lambda x: {_STRIP}), lambda x: x <> '') as l from tr)
select doc_id, unnest(l) as speech, generate_subscripts(l, 1) - 1 as speech_no from s1""")
def speech_split(spark: SparkSession, d: str) -> DataFrame:
    return texts.split_speeches(R.transcripts(spark, d), "doc_id", "text", faithful=True)


@query(f"with {SPEECH} select graph_id, doc_id, speech_no, speaker from s4")
def speech_first_speaker(spark: SparkSession, d: str) -> DataFrame:
    return R.speeches(spark, d).where(F.size("names") > 0).select("graph_id", "doc_id", "speech_no", F.col("names")[0].alias("speaker"))


@query(f"with {SPEECH} select graph_id, speaker as src, mention as dst, count(distinct (doc_id, speech_no)) as weight from mr where mention is not null and mention <> speaker group by 1, 2, 3")
def mention_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.mention_edges(R.mention_rows(spark, d), ["doc_id", "speech_no"])


@query(f"""with {SPEECH}, se1 as (select graph_id, doc_id, speech_no, -1 as pos, speaker as label from mr union all select graph_id, doc_id, speech_no, coalesce(pos, 0), mention from mr),
f1 as (select *, row_number() over (partition by graph_id, label order by doc_id, speech_no, pos) as r from se1 where label is not null)
select graph_id, label, row_number() over (partition by graph_id order by doc_id, speech_no, pos, label) as id from f1 where r = 1""")
def mention_vertices_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices_first_seen(R.mention_rows(spark, d), ["doc_id", "speech_no"])


@query(f"with {SPEECH} select graph_id, doc_id, speech_no, speaker, mention from mr where mention is not null and mention <> speaker")
def self_mention_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.mention_rows(spark, d).where("mention is not null and mention <> speaker").select("graph_id", "doc_id", "speech_no", "speaker", "mention")


@query(f"""with {TR}, p as (select doc_id, text, length(text) as n, least(1000, length(text)) as w from tr where length(text) > 0), q as (select *, least(200, w - 1) as o from p),
c as (select *, unnest(range(0, cast(ceil(greatest(1, n - o) / (w - o)::double) as bigint))) as chunk from q)
select doc_id, chunk, chunk * (w - o) as start, least(chunk * (w - o) + w, n) as "end", substr(text, chunk * (w - o) + 1, least(chunk * (w - o) + w, n) - chunk * (w - o)) as piece from c""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return texts.chunk_windows(R.transcripts(spark, d), "doc_id", "text")


@query("select cmp_id, regexp_replace(nfc_normalize('<B>' || raw_text || '</B> <b>'), '</?[A-Z]+>', '', 'g') as cleaned from compare_outputs where raw_text is not null")
def clean_tags(spark: SparkSession, d: str) -> DataFrame:
    """Composed text without tags of capitals."""
    c = table(spark, d, "compare_outputs").where("raw_text is not null")
    return c.select("cmp_id", X.cleaned(F.concat(F.lit("<B>"), "raw_text", F.lit("</B> <b>"))).alias("cleaned"))


@query("select cmp_id, '[PESSOA:' || raw_text || '] e [PESSOA:' || raw_text || ']' as mended from compare_outputs where raw_text is not null")
def residual_tags(spark: SparkSession, d: str) -> DataFrame:
    """Annotations put around twice, and empty ones on both sides of a name, are mended."""
    tag = lambda *p: F.concat(*[F.lit(x) if x != "raw_text" else F.col(x) for x in p])
    c = table(spark, d, "compare_outputs").where("raw_text is not null")
    return c.select("cmp_id", X.mend_tags(tag("[PESSOA:[PESSOA:", "raw_text", "]] e [PESSOA:]", "raw_text", "[PESSOA:]")).alias("mended"))


@query("select name_id, coalesce(nullif(word, ''), name_id::varchar) as label from name_record")
def label_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name_record").select("name_id", X.label_or(F.col("word"), F.col("name_id"), F.lit(0)).alias("label"))


@query("select distinct doc_id, regexp_replace(split_part(doc_id, '/', 3) || '.annotated.txt', '[.][^.]*$', '') as base from transcript")
def path_base_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcript").select("doc_id", X.base_name(F.concat("doc_id", F.lit(".annotated.txt"))).alias("base")).distinct()


def _key_sql(word: str) -> str:
    space = "[\\s\\x{0B}\\x{85}\\pZ]+"
    x = f"regexp_replace(trim(regexp_replace({word}, '{space}', ' ', 'g')), '(?i) ?[(](?:[^()/]*/)?[A-Z]+ ?- ?[A-Z][A-Z][)] ?$', '')"
    x = f"regexp_replace(trim({x}), '(?: ?[-/] ?| )[A-Z][A-Z]+ ?- ?[A-Z][A-Z] ?[)]? ?$', '')"
    x = f"regexp_replace(trim({x}), '(?i)^(?:{'|'.join(X.TITLES)})[.]? +', '')"
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents(trim({x}))), '[.,;:!?()\"\\\\]', '', 'g'), '{space}', ' ', 'g'))"


_KEY = _key_sql("word")


@query(f"select speech_id, word, case when length({_KEY}) >= 2 then {_KEY} end as name_key from (select distinct min(speech_id) as speech_id, word from speech_mention where word is not null group by word)")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "speech_mention").where("word is not null").groupBy("word").agg(F.min("speech_id").alias("speech_id"))
    return w.select("speech_id", "word", X.name_key(F.col("word")).alias("name_key"))


_GOLD = "concat_ws('', coalesce(title, '-'), ' <', word, '> (', coalesce(party, ''), ') <', coalesce(state, '??'), '> a < b')"


@query(f"""with r as (select distinct doc_id, speaker_no, title, word, party, state from session_speaker where word is not null), k as (select doc_id || '#' || row_number() over (partition by doc_id order by speaker_no, title, word, party, state) as doc_id, coalesce(title, '-') as t, word as w, coalesce(party, '') as p, coalesce(state, '??') as s from r)
select doc_id, 0::bigint as tag_no, w as surface, length(t) + 1 as start, length(t) + 1 + length(w) as "end" from k union all
select doc_id, 1, s, length(t) + 1 + length(w) + 2 + length(p) + 2, length(t) + 1 + length(w) + 2 + length(p) + 2 + length(s) from k""")
def tag_extract_offsets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = table(spark, d, "session_speaker").where("word is not null").select("doc_id", "speaker_no", "title", "word", "party", "state").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("speaker_no", "title", "word", "party", "state")]))
    gold = r.select(F.concat_ws("#", "doc_id", n.cast("string")).alias("doc_id"), F.expr(_GOLD).alias("gold"))
    return texts.extract_tags(gold, "doc_id", "gold")


@query(f"with {AN} select doc_id, annotated from an")
def tag_insert(spark: SparkSession, d: str) -> DataFrame:
    return R.annotated(spark, d)


@query(f"with {TR} select doc_id, text from tr")
def tag_insert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return R.annotated(spark, d).select("doc_id", X.without_person_tags(F.col("annotated")).alias("text"))


# ---- entities -------------------------------------------------------------------------------------------
@query()
def rule_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.rule_entities(R.transcripts(spark, d), "doc_id", "text")


@query()
def recognised_persons(spark: SparkSession, d: str) -> DataFrame:
    return entities.recognise(R.transcripts(spark, d), "doc_id", "text")


@query(f"""with {PE}, a as (select *, max("end") over (partition by doc_id order by start, mention_id rows between unbounded preceding and 1 preceding) as seen from pe),
b as (select *, case when seen is null or start > seen + 1 then 1 else 0 end as new from a), c as (select *, sum(new) over (partition by doc_id order by start, mention_id) as island from b),
e as (select *, case when new = 1 then word when seen - start >= 0 then substr(word, seen - start + 1) else ' ' || word end as piece from c)
select doc_id, min(start) as start, max("end") as "end", string_agg(piece, '' order by start, mention_id) as word, min(score) as score from e group by doc_id, island""")
def merge_adjacent_spans(spark: SparkSession, d: str) -> DataFrame:
    return entities.merge_adjacent(R.persons(spark, d), "doc_id", "mention_id")


@query(f"with {PE} select * from pe")
def dedup_spans_keep_best(spark: SparkSession, d: str) -> DataFrame:
    return R.persons(spark, d)


@query(f"""with {PE}, g as (select distinct doc_id, word, start, "end", round(cast(score as decimal(12, 6)), 4)::double as score from pe)
select doc_id, word, string_agg(start || ':' || "end" || ':' || coalesce(printf('%.4f', score), '-'), ',' order by start, "end", score nulls first) as positions from g group by 1, 2""")
def group_positions(spark: SparkSession, d: str) -> DataFrame:
    g = entities.group_positions(R.persons(spark, d), "doc_id", "word")
    score = F.transform("positions", lambda p: F.when(p["score"].isNull(), F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), F.lit("-"))).otherwise(F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), F.format_string("%.4f", p["score"]))))
    return g.select("doc_id", "word", F.array_join(score, ",").alias("positions"))


@query()
def group_similar_persons(spark: SparkSession, d: str) -> DataFrame:
    return entities.group_similar(R.persons(spark, d), "doc_id")


@query()
def group_similar_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where the words of each canonical name stand."""
    return entities.group_similar_positions(R.persons(spark, d), "doc_id")


# ---- evaluation -----------------------------------------------------------------------------------------
def _matched(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_overlap(R.gold(spark, d), R.predicted(spark, d), "doc_id")


@query(f"with {GO} select doc_id, gold_id, pred_id from ma")
def overlap_join_first_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("doc_id", "gold_id", "pred_id")


@query(f"with {GO} select doc_id, gold_id from go where not exists (select 1 from ma where ma.doc_id = go.doc_id and ma.gold_id = go.gold_id)")
def false_negatives_anti(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed(R.gold(spark, d), _matched(spark, d), "doc_id").select("doc_id", "gold_id")


@query(f"with {GO} select doc_id, pred_id from pr where not exists (select 1 from ma where ma.doc_id = pr.doc_id and ma.pred_id = pr.pred_id)")
def false_positives_anti(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.spurious(R.predicted(spark, d), _matched(spark, d), "doc_id").select("doc_id", "pred_id")


@query(f"with {OU} select doc_id, canon, start, \"end\", p_start, p_end, outcome, reason from ou where outcome in ('TP', 'DM')")
def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.outcomes(_matched(spark, d), R.gold(spark, d), R.predicted(spark, d), "doc_id")
    return out.select("doc_id", "canon", "start", "end", "p_start", "p_end", "outcome", "reason")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.all_outcomes(R.gold(spark, d), R.predicted(spark, d), "doc_id")


@query(f"with {OU} select * from ou")
def evaluation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the whole evaluation, computed from the spans of both sides."""
    return _outcomes(spark, d)


@query(f"with {GO} select doc_id, coalesce(g.n, 0) as gold_total, coalesce(p.n, 0) as pred_total from (select doc_id, count(*) as n from go group by 1) g full join (select doc_id, count(*) as n from pr group by 1) p using (doc_id)")
def evaluation_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.totals(R.gold(spark, d), R.predicted(spark, d), "doc_id")


def _report_sql() -> str:
    shown = lambda name, c, r, a, b: f"case when {a} is not null then '{name}: ' || coalesce({c}, 'null') || ' | ' || coalesce({r}, 'null') || ' @ (' || {a} || ', ' || {b} || ')' end"
    kinds = {"TP": 1, "DM": 2, "FN": 3, "FP": 4}
    part = "case outcome " + " ".join(f"when '{k}' then {n}" for k, n in kinds.items()) + " end"
    return f"""with {OU}, c as (select count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'DM') as dm, count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'FP') as fp from ou),
q as (select *, coalesce(tp / nullif(tp + fp + dm, 0)::double, 0) as ps, coalesce(tp / nullif(tp + fn + dm, 0)::double, 0) as rs, coalesce((tp + dm) / nullif(tp + dm + fp, 0)::double, 0) as pl, coalesce((tp + dm) / nullif(tp + dm + fn, 0)::double, 0) as rl from c),
f as (select *, coalesce(2 * ps * rs / nullif(ps + rs, 0), 0) as fs, coalesce(2 * pl * rl / nullif(pl + rl, 0), 0) as fl from q),
h as (select unnest(['## NER comparison', '- gold occurrences: ' || (tp + dm + fn), '- TP: ' || tp, '- DM: ' || dm, '- FN: ' || fn, '- FP: ' || fp{"".join(f", '- {k} ({how}): ' || printf('%.4f', {k[0]}{how[0]})" for how in ("strict", "lenient") for k in ("precision", "recall", "f1"))}]) as line, unnest(range(0, 12)) as "at" from f)
select 0 as part, '' as name, "at", line from h
{"".join(f"union all select {n}, '', -1, '### {k}' || case when {k.lower()} = 0 then chr(10) || '- none' else '' end from c " for k, n in kinds.items())}
union all select {part}, coalesce(canon, p_canon), coalesce(start, p_start), '- ' || concat_ws(' | ', {shown('gold', 'canon', 'raw', 'start', '"end"')}, {shown('found', 'p_canon', 'p_raw', 'p_start', 'p_end')}, reason) from ou"""


@query(_report_sql())
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report_lines(checkpoint(_outcomes(spark, d)))


@query("""with al as (select unnest(original_names) as alias, min(canonical_name) as canonical from name_entry group by 1),
g as (select distinct doc_id, coalesce(canonical, manual_raw) as name, manual_start as s, manual_end as e from compare_outputs left join al on alias = manual_raw where manual_raw is not null and manual_start is not null and manual_end is not null)
select doc_id, name, string_agg(s || ':' || e, ',' order by s, e) as positions from g group by 1, 2""")
def gold_positions(spark: SparkSession, d: str) -> DataFrame:
    """Manual entities grouped under the canonical names of the register."""
    e = table(spark, d, "name_entry").select(F.explode("original_names").alias("alias"), "canonical_name").groupBy("alias").agg(F.min("canonical_name").alias("canonical"))
    c = table(spark, d, "compare_outputs").select("doc_id", F.col("manual_raw").alias("text"), F.col("manual_start").alias("original_start"), F.col("manual_end").alias("original_end"))
    spots = F.array_join(F.transform("positions", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return files.gold_positions(c, "doc_id", e).select("doc_id", "name", spots.alias("positions"))


def _prf_sql(kind: str) -> str:
    hit, p, r = ("tp", "tp + fp + dm", "tp + fn + dm") if kind == "strict" else ("tp + dm", "tp + dm + fp", "tp + dm + fn")
    return f"""with {OU}, c as (select split_part(doc_id, '/', 1) as fonte, count(*) filter (where outcome = 'TP') as tp, count(*) filter (where outcome = 'DM') as dm, count(*) filter (where outcome = 'FN') as fn, count(*) filter (where outcome = 'FP') as fp from ou group by 1),
s as (select *, coalesce(({hit}) / nullif({p}, 0)::double, 0) as p, coalesce(({hit}) / nullif({r}, 0)::double, 0) as r from c)
select fonte, tp, dm, fn, fp, round(p, 6) as precision_{kind}, round(r, 6) as recall_{kind}, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1_{kind} from s"""


def _prf(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Scores a house of the outcomes computed from the spans."""
    rows = _outcomes(spark, d).withColumn("fonte", F.split_part("doc_id", F.lit("/"), F.lit(1)))
    cols = [f"{c}_{kind}" for c in ("precision", "recall", "f1")]
    return _rounded(evaluate.scores(rows, "outcome", ["fonte"]).select("fonte", "tp", "dm", "fn", "fp", *cols), *cols)


@query(_prf_sql("strict"))
def prf_strict(spark: SparkSession, d: str) -> DataFrame:
    return _prf(spark, d, "strict")


@query(_prf_sql("lenient"))
def prf_lenient(spark: SparkSession, d: str) -> DataFrame:
    return _prf(spark, d, "lenient")


# ---- graphs ---------------------------------------------------------------------------------------------
for _name, _expr in {"degree_total": "in_degree + out_degree", "degree_in": "in_degree", "degree_out": "out_degree", "strength_total": "in_strength + out_strength", "strength_in": "in_strength", "strength_out": "out_strength"}.items():

    def _degree(spark: SparkSession, d: str, expr: str = _expr, name: str = _name) -> DataFrame:
        return graph.degrees(R.speech_edges(spark, d)).select("graph_id", "vertex", F.expr(expr).alias(name))

    _degree.__name__ = _name
    query(f"with {ED}, {DE} select graph_id, vertex, {_expr} as {_name} from de")(_degree)


def _values(spark: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(R.speech_edges(spark, d))
    kinds = F.explode(F.array(F.struct(F.lit("degree").alias("kind"), F.col("degree").alias("x")), F.struct(F.lit("strength").alias("kind"), F.col("strength").alias("x"))))
    return deg.select("graph_id", kinds.alias("v")).select("graph_id", "v.kind", "v.x")


VA = f"{ED}, {DE}, va as (select graph_id, 'degree' as kind, in_degree + out_degree as x from de union all select graph_id, 'strength', in_strength + out_strength from de), di as (select graph_id, kind, x, count(*) as n from va group by 1, 2, 3), dp as (select *, n / sum(n) over (partition by graph_id, kind)::double as p, sum(n) over (partition by graph_id, kind order by x desc) / sum(n) over (partition by graph_id, kind)::double as ccdf from di)"


@query(f"with {VA} select graph_id, kind, x, n from di")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(_values(spark, d)).select("graph_id", "kind", "x", "n")


@query(f"with {VA} select graph_id, kind, x, round(p, 6) as p from dp")
def degree_pdf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.distribution(_values(spark, d)).select("graph_id", "kind", "x", "p"), "p")


@query(f"with {VA} select graph_id, kind, x, round(ccdf, 6) as ccdf from dp where kind = 'strength'")
def strength_ccdf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.distribution(_values(spark, d).where("kind = 'strength'")).select("graph_id", "kind", "x", "ccdf"), "ccdf")


@query(f"with {ED}, {UN}, ud as (select graph_id, v, count(*) as x from (select graph_id, src as v from un union all select graph_id, dst from un) group by 1, 2), di as (select graph_id, x, count(*) as n from ud group by 1, 2) select graph_id, x, n, round(sum(n) over (partition by graph_id order by x desc) / sum(n) over (partition by graph_id)::double, 6) as ccdf from di")
def degree_ccdf_undirected(spark: SparkSession, d: str) -> DataFrame:
    und = graph.undirected_degree(R.speech_edges(spark, d)).select("graph_id", F.lit("degree").alias("kind"), F.col("degree").alias("x"))
    return _rounded(stats.distribution(und).select("graph_id", "x", "n", "ccdf"), "ccdf")


def _fit_sql(keep: str) -> str:
    return f"""with {VA}, k as (select *, row_number() over (partition by graph_id, kind order by x) as r, floor(0.1 * count(*) over (partition by graph_id, kind)) as cut from di where x > 0 and n > 0),
f as (select graph_id, kind, count(*) as points, regr_slope(log10(n), log10(x)) as slope, regr_intercept(log10(n), log10(x)) as intercept, regr_r2(log10(n), log10(x)) as r2 from k where {keep} group by 1, 2)
select graph_id, kind, points, case when points >= 3 then round(slope, 6) end as slope, case when points >= 3 then round(intercept, 6) end as intercept, case when points >= 3 then round(r2, 6) end as r2 from f"""


@query(_fit_sql("r <= cut"))
def loglog_fit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.loglog_fit(stats.distribution(_values(spark, d))), "slope", "intercept", "r2")


@query(_fit_sql("r > cut"))
def loglog_fit_tail(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.loglog_fit(stats.distribution(_values(spark, d)), keep_head=False), "slope", "intercept", "r2")


@query()
def power_law_fit(spark: SparkSession, d: str) -> DataFrame:
    return stats.power_law_fit(stats.distribution(_values(spark, d)))


@query(f"with {VA} select graph_id, kind, round(avg(x), 6) as mean, min(x) as least, max(x) as most, round(stddev_pop(x), 6) as deviation from va group by 1, 2")
def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.summary(_values(spark, d)), "mean", "deviation")


SZ = "sz as (select v.graph_id, v.vertices, e.edges from (select graph_id, count(*) as vertices from ve group by 1) v join (select graph_id, count(*) as edges from ed group by 1) e using (graph_id))"


@query(f"with {ED}, {SZ} select graph_id, vertices, edges, round(edges / (vertices * (vertices - 1))::double, 6) as density from sz")
def density_directed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.sizes(R.speech_edges(spark, d)).select("graph_id", "vertices", "edges", "density"), "density")


@query(f"with {ED}, {SZ} select graph_id, round(2 * edges / (vertices * (vertices - 1))::double, 6) as density_undirected from sz")
def density_undirected_formula(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.sizes(R.speech_edges(spark, d)).select("graph_id", "density_undirected"), "density_undirected")


@query(f"with {ED}, {SZ} select graph_id, round(2 * edges / vertices::double, 6) as average_degree from sz")
def average_degree(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.sizes(R.speech_edges(spark, d)).select("graph_id", "average_degree"), "average_degree")


CL = """tw as (select graph_id, max(weight) as top from ed group by 1), hw as (select ed.graph_id, src, dst, cbrt(weight / top::double) as w from ed join tw using (graph_id)),
sy as (select graph_id, a, b, sum(w) as w from (select graph_id, src as a, dst as b, w from hw union all select graph_id, dst, src, w from hw) group by 1, 2, 3),
tr3 as (select x.graph_id, x.a as v, sum(x.w * y.w * z.w) as t from sy x join sy y on y.graph_id = x.graph_id and y.a = x.b join sy z on z.graph_id = x.graph_id and z.a = y.b and z.b = x.a group by 1, 2),
bi as (select p.graph_id, p.src as v, count(*) as n from ed p join ed q on q.graph_id = p.graph_id and q.src = p.dst and q.dst = p.src group by 1, 2),
dt as (select graph_id, v, count(*) as n from (select graph_id, src as v from ed union all select graph_id, dst from ed) group by 1, 2),
cl as (select ve.graph_id, avg(coalesce(t / (2 * (dt.n * (dt.n - 1) - 2 * coalesce(bi.n, 0))), 0)) as clustering from ve left join tr3 on tr3.graph_id = ve.graph_id and tr3.v = ve.vertex left join bi on bi.graph_id = ve.graph_id and bi.v = ve.vertex left join dt on dt.graph_id = ve.graph_id and dt.v = ve.vertex group by 1)"""


@query(f"with {ED}, {CL} select graph_id, round(clustering, 6) as clustering from cl")
def clustering_weighted_directed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.clustering(checkpoint(R.speech_edges(spark, d))), "clustering")


def _squared(n: int = 5) -> str:
    out = ["d0 as (select src as a, dst as b, min(weight)::double as w from ed group by 1, 2)"]
    for i in range(n):
        out.append(f"d{i + 1} as (select a, b, min(w) as w from (select a, b, w from d{i} union all select x.a, y.b, x.w + y.w from d{i} x join d{i} y on x.b = y.a where x.a <> y.b) group by 1, 2)")
    return ", ".join(out)


@query(f"with {NA}, {_squared()} select 'n' as graph_id, round(avg(w), 6) as avg_distance, count(*) as reachable_pairs from d5")
def path_average(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.path_summary(R.nation_edges(spark, d)).select("graph_id", "avg_distance", "reachable_pairs"), "avg_distance")


@query(f"with {NA}, {_squared()} select 'n' as graph_id, max(w) as diameter from d5")
def path_diameter(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_summary(R.nation_edges(spark, d)).select("graph_id", "diameter")


@query(f"with {NA}, {SZ}, {CL}, {_squared()} select sz.graph_id, vertices, edges, round(2 * edges / vertices::double, 6) as average_degree, round(edges / (vertices * (vertices - 1))::double, 6) as density, round(clustering, 6) as clustering, (select round(avg(w), 6) from d5) as avg_distance, (select max(w) from d5) as diameter from sz join cl using (graph_id)")
def graph_metrics_row(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.metrics(checkpoint(R.nation_edges(spark, d))), "average_degree", "density", "clustering", "avg_distance")


@query()
def graph_metrics_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(checkpoint(R.speech_edges(spark, d)))


@query(f"with {NA}, {UN}, m as (select count(*) as m from un), pl as (select x.community as cs, y.community as cd from un join me x on x.vertex = un.src join me y on y.vertex = un.dst), l as (select cs as c, count(*) as l from pl where cs = cd group by 1), dg as (select c, count(*) as d from (select cs as c from pl union all select cd from pl) group by 1) select 'n' as graph_id, round(sum(coalesce(l, 0) / m::double - pow(d / (2.0 * m), 2)), 6) as modularity from dg left join l using (c) cross join m")
def modularity_fixed_partition(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.modularity(R.nation_edges(spark, d), R.nation_regions(spark, d)), "modularity")


@query(f"with {NA}, {DE}, r as (select me.graph_id, me.vertex, community, in_degree + out_degree as degree, row_number() over (partition by community order by in_degree + out_degree desc, me.vertex) as rank from me join de on de.vertex = me.vertex) select * from r where rank <= 3")
def community_leaders_top3(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaders(R.nation_regions(spark, d), graph.degrees(R.nation_edges(spark, d)))


def _parties(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "speech_mention").where("word is not null and graph_id is not null").select("graph_id", F.col("word").alias("vertex")).distinct()
    return words.withColumn("community", F.element_at(F.split("vertex", " "), -1))


PA = "pa as (select distinct graph_id, word as vertex, string_split(word, ' ')[-1] as community from speech_mention where word is not null and graph_id is not null), cs as (select graph_id, community, count(*) as size from pa group by 1, 2)"


@query(f"with {PA}, r as (select *, row_number() over (partition by graph_id order by size desc, community) as k from cs) select graph_id, case when k <= 12 then k else 13 end as rank, case when k <= 12 then community end as community, count(*) as communities, sum(size)::bigint as members from r group by 1, 2, 3")
def community_rank_top12_rest(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_ranks(_parties(spark, d))


@query(f"with {PA} select graph_id, size, count(*) as communities from cs group by 1, 2")
def community_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _parties(spark, d).groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("size")).groupBy("graph_id", "size").agg(F.count(F.lit(1)).alias("communities"))


@query(f"with {NA} select ed.graph_id, src, dst, weight, x.community = y.community as intra, case when x.community = y.community then 15.0 else 0.05 end::double as layout_weight, case when x.community = y.community then 0.8 else 0.05 end::double as alpha from ed join me x on x.vertex = src join me y on y.vertex = dst")
def edge_intra_inter(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_kinds(R.nation_edges(spark, d), R.nation_regions(spark, d))


@query(f"with {NA}, {DE}, j as (select me.graph_id, me.vertex, community, in_degree + out_degree as degree, count(*) over (partition by community) as size from me join de on de.vertex = me.vertex) select *, round(case when min(degree) over () = max(degree) over () then 30.0 else 3 + 150 * (degree - min(degree) over ()) / (max(degree) over () - min(degree) over ())::double end, 6) as scaled, round(10 * ln(degree + 1) * ln(size + 1) / ln(max(size) over () + 1), 6) as composite from j")
def vertex_plot_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.vertex_sizes(R.nation_regions(spark, d), graph.degrees(R.nation_edges(spark, d))), "scaled", "composite")


# The same operators on the mention graphs of speeches, all rows of them; the partition is the last word of a name, so that SQL can tell it.
_MW = "me as (select graph_id, vertex, string_split(vertex, ' ')[-1] as community from ve)"
_PLACED = "pl as (select un.graph_id, x.community as cs, y.community as cd from un join me x on x.graph_id = un.graph_id and x.vertex = un.src join me y on y.graph_id = un.graph_id and y.vertex = un.dst)"


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = checkpoint(R.speech_edges(spark, d))
    return e, graph.vertices_of(e).withColumn("community", F.element_at(F.split("vertex", " "), -1))


@query(f"with {ED}, {UN}, {_MW}, {_PLACED}, m as (select graph_id, count(*) as m from un group by 1), l as (select graph_id, cs as c, count(*) as l from pl where cs = cd group by 1, 2), dg as (select graph_id, c, count(*) as d from (select graph_id, cs as c from pl union all select graph_id, cd from pl) group by 1, 2) select graph_id, round(sum(coalesce(l, 0) / m::double - pow(d / (2.0 * m), 2)), 6) as modularity from dg left join l using (graph_id, c) join m using (graph_id) group by 1")
def modularity_words(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.modularity(*_words(spark, d)), "modularity")


@query(f"with {ED}, {DE}, {_MW}, r as (select me.graph_id, me.vertex, community, in_degree + out_degree as degree, row_number() over (partition by me.graph_id, community order by in_degree + out_degree desc, me.vertex) as rank from me join de on de.graph_id = me.graph_id and de.vertex = me.vertex) select * from r where rank <= 3")
def community_leaders_words(spark: SparkSession, d: str) -> DataFrame:
    e, members = _words(spark, d)
    return graph.leaders(members, graph.degrees(e))


@query(f"with {ED}, {_MW} select ed.graph_id, src, dst, weight, x.community = y.community as intra, case when x.community = y.community then 15.0 else 0.05 end::double as layout_weight, case when x.community = y.community then 0.8 else 0.05 end::double as alpha from ed join me x on x.graph_id = ed.graph_id and x.vertex = src join me y on y.graph_id = ed.graph_id and y.vertex = dst")
def edge_intra_inter_words(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_kinds(*_words(spark, d))


@query(f"with {ED}, {DE}, {_MW}, j as (select me.graph_id, me.vertex, community, in_degree + out_degree as degree, count(*) over (partition by me.graph_id, community) as size from me join de on de.graph_id = me.graph_id and de.vertex = me.vertex) select *, round(case when min(degree) over g = max(degree) over g then 30.0 else 3 + 150 * (degree - min(degree) over g) / (max(degree) over g - min(degree) over g)::double end, 6) as scaled, round(10 * ln(degree + 1) * ln(size + 1) / ln(max(size) over g + 1), 6) as composite from j window g as (partition by graph_id)")
def vertex_plot_sizes_words(spark: SparkSession, d: str) -> DataFrame:
    e, members = _words(spark, d)
    return _rounded(graph.vertex_sizes(members, graph.degrees(e)), "scaled", "composite")


_SIZES = "si as (select graph_id, community, count(*) as size from me group by 1, 2)"


@query(f"with {ED}, {_MW}, {_SIZES} select graph_id, count(*) as communities, max(size) as most, min(size) as least, round(avg(size), 6) as mean, round(stddev_pop(size), 6) as deviation from si group by 1")
def community_size_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.community_sizes(_words(spark, d)[1]), "mean", "deviation")


@query(f"with {ED}, {_MW}, {_SIZES}, r as (select *, row_number() over (partition by graph_id order by size desc, community) as rank from si) select * from r where rank <= 15")
def community_largest_sizes(spark: SparkSession, d: str) -> DataFrame:
    return stats.largest_sizes(_words(spark, d)[1])


@query(f"with {ED}, {UN} select graph_id, src, dst, 1 as weight from un union all select graph_id, dst, src, 1 from un")
def undirected_to_directed(spark: SparkSession, d: str) -> DataFrame:
    return graph.to_directed(graph.undirected(R.speech_edges(spark, d)).withColumn("weight", F.lit(1)))


@query(f"""with {SPEECH}, nm as (select distinct graph_id, name from (select graph_id, speaker as name from mr union all select graph_id, mention from mr) where name is not null and name <> ''),
ky as (select graph_id, name, case when length({_key_sql('name')}) >= 2 then {_key_sql('name')} else name end as k from nm), ca as (select graph_id, name, first_value(name) over (partition by graph_id, k order by length(name) desc, name) as canonical from ky),
rs as (select mr.graph_id, mr.doc_id, speech_no, coalesce(a.canonical, speaker) as src, coalesce(b.canonical, mention) as dst from mr left join ca a on a.graph_id = mr.graph_id and a.name = speaker left join ca b on b.graph_id = mr.graph_id and b.name = mention)
select graph_id, src, dst, count(distinct (doc_id, speech_no)) as weight from rs where dst is not null and src <> dst group by 1, 2, 3""")
def mention_edges_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the annotated transcripts with names of one key brought together before anything is counted."""
    rows = checkpoint(R.mention_rows(spark, d))
    return graph.mention_edges(resolve.resolved_mentions(rows, resolve.resolve_by_key(resolve.names_of(rows))), ["doc_id", "speech_no"])


@query()
def mention_edges_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The same with similar names brought together too."""
    rows = checkpoint(R.mention_rows(spark, d))
    return graph.mention_edges(resolve.resolved_mentions(rows, checkpoint(resolve.resolve_at_scale(resolve.names_of(rows)))), ["doc_id", "speech_no"])


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.louvain(R.speech_edges(spark, d))


@query()
def layout_coordinates(spark: SparkSession, d: str) -> DataFrame:
    e = R.nation_edges(spark, d)
    return graph.layout(graph.edge_kinds(e, R.nation_regions(spark, d)).select("graph_id", "src", "dst", "layout_weight"))


# The operators above on the mention graphs of speeches, all rows of them, with the communities found there.  Louvain has no SQL, so these have none.
def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = checkpoint(R.speech_edges(spark, d))
    return e, checkpoint(graph.louvain(e))


@query()
def path_average_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_summary(checkpoint(R.speech_edges(spark, d))).select("graph_id", "avg_distance", "reachable_pairs")


@query()
def path_diameter_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_summary(checkpoint(R.speech_edges(spark, d))).select("graph_id", "diameter")


@query()
def modularity_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.modularity(*_mentions(spark, d))


@query()
def community_leaders_speeches(spark: SparkSession, d: str) -> DataFrame:
    e, members = _mentions(spark, d)
    return graph.leaders(members, graph.degrees(e))


@query()
def edge_intra_inter_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_kinds(*_mentions(spark, d))


@query()
def vertex_plot_sizes_speeches(spark: SparkSession, d: str) -> DataFrame:
    e, members = _mentions(spark, d)
    return graph.vertex_sizes(members, graph.degrees(e))


@query()
def layout_coordinates_speeches(spark: SparkSession, d: str) -> DataFrame:
    return graph.layout(graph.edge_kinds(*_mentions(spark, d)).select("graph_id", "src", "dst", "layout_weight"))


def _gexf_sql() -> str:
    esc = "replace(replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(10), '&#10;')"
    frame = " ".join(f"union all select graph_id, {k}, 0, '{v}' from (select distinct graph_id from vx)" for k, v in files.GEXF_FRAME.items())
    return f"""with {SPEECH}, se1 as (select graph_id, doc_id, speech_no, -1 as pos, speaker as label from mr union all select graph_id, doc_id, speech_no, coalesce(pos, 0), mention from mr),
f1 as (select *, row_number() over (partition by graph_id, label order by doc_id, speech_no, pos) as r from se1 where label is not null),
vx as (select graph_id, label, row_number() over (partition by graph_id order by doc_id, speech_no, pos, label) as id from f1 where r = 1),
me as (select graph_id, speaker as src, mention as dst, count(distinct (doc_id, speech_no)) as weight from mr where mention is not null and mention <> speaker group by 1, 2, 3)
select graph_id, 1 as part, id as seq, '      <node id="' || id || '" label="' || {esc} || '" />' as line from vx
union all select me.graph_id, 3, a.id * 2147483648 + b.id, '      <edge source="' || a.id || '" target="' || b.id || '" weight="' || weight || '" />' from me join vx a on a.graph_id = me.graph_id and a.label = src join vx b on b.graph_id = me.graph_id and b.label = dst
{frame}"""


@query(_gexf_sql())
def gexf_document(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpoint(R.mention_rows(spark, d))
    return files.gexf_lines(graph.vertices_first_seen(rows, ["doc_id", "speech_no"]), graph.mention_edges(rows, ["doc_id", "speech_no"]))


# ---- names ----------------------------------------------------------------------------------------------
@query()
def fuzzy_token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "name_match")
    return m.select("match_id", token_set_ratio(X.name_key(F.col("original_name")), X.name_key(F.col("canonical_name"))).alias("ratio"))


@query("select name_id, word, coalesce(canonical, word) as canonical from name_record left join (select unnest(original_names) as alias, min(canonical_name) as canonical from name_entry group by 1) a on a.alias = word")
def alias_left_join_default(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "name_entry").select(F.explode("original_names").alias("alias"), "canonical_name").groupBy("alias").agg(F.min("canonical_name").alias("canonical"))
    return files.with_alias(table(spark, d, "name_record").select("name_id", "word"), "word", e)


def _ordered_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "speech_mention").where("word is not null and graph_id is not null")
    return m.groupBy("graph_id", F.col("word").alias("name")).agg(F.min("speech_id").alias("first")).select("graph_id", F.coalesce(F.col("first"), F.lit(1 << 62)).alias("seq"), "name")


@query()
def resolve_names_faithful(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_in_order(_ordered_names(spark, d))


@query()
def resolve_names_scalable(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_at_scale(_ordered_names(spark, d))
