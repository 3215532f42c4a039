"""The same results in plain SQL (DuckDB dialect) over the given tables, written independently.

``CTES`` holds named building blocks; ``_sql`` prepends the ones a statement needs.
"""

from __future__ import annotations

import re

from ..schemas import ALLOWED_TRANSITIONS, MIME_BY_SUFFIX, PRESETS, PROFILES


def rnd(expr: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr})*{scale}+0.5)/{scale})"


def ms(expr: str) -> str:
    return f"cast(floor(({expr})*1000.0+0.5) as bigint)"


def total(expr: str, unit_digits: int = 8) -> str:
    """Sum in whole units."""
    return f"sum(cast(floor(({expr})*1e{unit_digits}+0.5) as hugeint))"


def mean(expr: str, digits: int = 8, unit_digits: int = 8) -> str:
    """Mean of whole units, rounded half-up on integers."""
    step = f"(count({expr})*{10 ** (unit_digits - digits)}::hugeint)"
    whole = f"(2*{total(expr, unit_digits)} + {step})"
    return f"(case when count({expr}) > 0 then (({whole} - (({whole} % (2*{step})) + 2*{step}) % (2*{step})) // (2*{step})) / 1e{digits}::double end)"


def clip(expr: str, low: str, high: str) -> str:
    return f"(case when ({expr}) is not null then greatest({low}, least({high}, {expr})) end)"


COS_NORM = clip("(score-0.05)/0.20", "0.0", "1.0")
NIMA, SHARP, CONT, COLOR, TECH = (f"coalesce({c},0.5)" for c in ("nima_aesthetic", "sharpness", "contrast", "colorfulness", "technical_composite"))
# what candidates are ordered by
RANK_VALUE = "coalesce(nullif(composite_rank,0), score)"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::double[], {b}::double[])"


CTES: dict[str, str] = {
    "base": """select *, vec_id // 8 as g, vec_id % 8 as pos, (vec_id // 8) % 2 = 0 as is_video,
        case when (vec_id // 8) % 2 = 0 then (vec_id // 8) * 8 else vec_id end as file_id from embeddings""",
    "raw_frames": """select b.vec_id, b.embedding as vector, b.label, b.file_id,
        '/media/' || case when is_video then 'v' else 'i' end || b.file_id || case when is_video then '.mp4' else '.jpg' end as file_path,
        case when is_video then 'video' else 'image' end as file_type,
        cast(case when is_video then pos else 0 end as integer) as frame_index,
        case when is_video then cast(pos as double) else cast(0 as double) end as source_offset,
        case when b.file_id % 17 = 0 then null else 1704067200 + (epoch(ev.ts) - 1704067200) * 10 end as creation_timestamp,
        case when is_video then cast(8 as double) end as duration_seconds,
        case when b.vec_id % 13 = 0 then null else least(v.value / 100, cast(1 as double)) end as nima_aesthetic,
        case when b.vec_id % 19 = 0 then null else least(abs(cast(embedding[1] as double)) * 4, cast(1 as double)) end as sharp,
        least(abs(cast(embedding[2] as double)) * 4, cast(1 as double)) as cont,
        least(abs(cast(embedding[3] as double)) * 4, cast(1 as double)) as color
        from base b left join events ev on ev.event_id = b.file_id left join events v on v.event_id = b.vec_id""",
    "frames": f"""select * exclude (sharp, cont, color), {rnd('sharp',4)} as sharpness, {rnd('cont',4)} as contrast, {rnd('color',4)} as colorfulness,
        {rnd('0.50*sharp + 0.15*color + 0.35*cont',4)} as technical_composite,
        md5(concat_ws('|', file_path, 'frame', cast({ms('source_offset')} as varchar), '-')) as point_id from raw_frames""",
    "scenes": """select f.file_id, s.scene_id, s.scene_start, s.scene_end from (select distinct file_id from frames where file_type='video') f,
        (values (0, 0.0::double, 4.0::double), (1, 4.0::double, 6.5::double)) s(scene_id, scene_start, scene_end)""",
    "tagged": """select f.*, s.scene_id, s.scene_start, s.scene_end from frames f left join (
          select f.vec_id, s.scene_id, s.scene_start, s.scene_end, row_number() over (partition by f.vec_id order by
            case when f.source_offset between s.scene_start and s.scene_end then 0 else 1 end, s.scene_id) rn
          from frames f join scenes s on s.file_id = f.file_id) s on s.vec_id = f.vec_id and s.rn = 1""",
    "scene_means": """select file_id, scene_id, list(x order by i) as v from (
          select file_id, scene_id, i, avg(cast(vector[i] as double)) as x from tagged, range(1, 65) t(i)
          where file_type = 'video' group by 1, 2, 3) group by 1, 2""",
    "scene_first": "select * from (select *, row_number() over (partition by file_id, scene_id order by frame_index) rn from tagged where file_type='video') where rn = 1",
    "scene_points": f"""select md5(concat_ws('|', f.file_path, 'scene', cast({ms('f.scene_start')} as varchar), cast(f.scene_id as varchar))) as point_id,
          cast(list_transform(m.v, lambda x: x / sqrt(list_dot_product(m.v, m.v))) as float[]) as vector,
          f.file_path, f.file_id, 'video' as file_type, -1 as frame_index, f.scene_start as source_offset, f.creation_timestamp, f.duration_seconds,
          'scene' as granularity, f.scene_id, f.scene_start, f.scene_end, a.n as scene_frame_count, true as is_scene_representative,
          case when f.nima_aesthetic is not null then a.nima end as nima_aesthetic,
          case when f.sharpness is not null then a.sharp end as sharpness,
          a.cont as contrast, a.color as colorfulness,
          case when f.technical_composite is not null then a.tech end as technical_composite
        from scene_first f join scene_means m using (file_id, scene_id) join (
          select file_id, scene_id, count(*) n, {mean(NIMA,4)} nima, {mean(SHARP,4)} sharp, {mean(CONT,4)} cont, {mean(COLOR,4)} color, {mean(TECH,4)} tech
          from tagged where file_type='video' group by 1, 2) a using (file_id, scene_id)""",
    "points": """select point_id, vector, file_path, file_id, file_type, frame_index, source_offset, creation_timestamp, duration_seconds,
          'frame' as granularity, scene_id, scene_start, scene_end, cast(null as bigint) as scene_frame_count, false as is_scene_representative,
          nima_aesthetic, sharpness, contrast, colorfulness, technical_composite from tagged
        union all select * from scene_points""",
    "queries": """select label as query_id, list(x order by i) as query_vector from (
          select label, i, avg(cast(embedding[i] as double)) as x from embeddings, range(1, 65) t(i) group by 1, 2) group by 1""",
    "jobs": "select 'job' || n as job_id, cast(20 + n * 15 as integer) as target_duration, 4 as min_segments from (select distinct query_id % 3 as n from queries)",
    "hits": f"""select * from (
          select 'job' || (query_id % 3) as job_id, query_id as query_idx, case when granularity='scene' then 0 else 1 end as pass, p.*,
            {rnd(cosine('p.vector','q.query_vector'),8)} as score,
            row_number() over (partition by query_id, granularity order by {rnd(cosine('p.vector','q.query_vector'),8)} desc, point_id) as rank
          from points p, queries q) where rank <= 15""",
    "seq_hits": """select *, (cast(query_idx as bigint) * 2 + pass) * 1000 + rank as seq,
          file_path || ':' || case when pass = 0 then 'scene_' || scene_id else 'offset_' || cast(source_offset as varchar) end as candidate_key from hits""",
    "merged": """select h.* exclude (seq, rn, first_seq), first_seq as seq from (
          select *, row_number() over (partition by job_id, candidate_key order by score desc, seq) rn,
            min(seq) over (partition by job_id, candidate_key) as first_seq from seq_hits) h where rn = 1""",
    "composed": f"select *, {rnd(f'0.45*{COS_NORM} + 0.45*{NIMA} + 0.10*{TECH}',4)} as composite_rank from merged",
    "passing": """select * exclude (p, n) from (select *, max(score >= 0.08) over (partition by job_id) as p,
          row_number() over (partition by job_id order by """ + RANK_VALUE + """ desc, seq) as n from composed) where score >= 0.08 or (not p and n <= 10)""",
    "capped": "select * exclude n from (select *, row_number() over (partition by job_id, file_path order by " + RANK_VALUE + " desc, seq) n from passing) where n <= 2",
    "ranked": "select *, row_number() over (partition by job_id order by " + RANK_VALUE + " desc, seq) - 1 as place from capped",
    "draft": """select job_id, place as seq, file_path, case when place % 2 = 0 then file_id end as file_id, source_offset as start_offset,
          case when file_type='video' then source_offset + 5.0 else 0.0 end as end_offset,
          case when file_type='video' then 5.0::double else 2.0::double end as duration,
          case when file_type='video' then 'video_clip' else 'image' end as segment_type, granularity as retrieval_strategy,
          case when place % 4 = 0 then score else 0.0 end as similarity_score, case when place % 9 = 0 then composite_rank end as composite_rank,
          case when place % 2 = 1 then creation_timestamp end as creation_timestamp, file_type
        from ranked where place % 3 = 0 or place = 1""",
    "deduped": """select d.job_id, d.seq, d.file_path, coalesce(nullif(d.file_id,0), c.file_id, d.file_id) as file_id, d.start_offset, d.end_offset, d.duration, d.segment_type, d.file_type,
          coalesce(nullif(d.similarity_score,0), c.score) as similarity_score, coalesce(nullif(d.composite_rank,0), c.composite_rank) as composite_rank,
          coalesce(nullif(d.creation_timestamp,0), c.creation_timestamp) as creation_timestamp,
          c.nima_aesthetic, c.sharpness, c.technical_composite
        from (select *, row_number() over (partition by job_id, file_path order by seq) n from draft) d
        join (select *, row_number() over (partition by job_id, file_path order by place desc) n from ranked) c
          on c.job_id = d.job_id and c.file_path = d.file_path and c.n = 1 where d.n = 1""",
    "kept_draft": "select * from deduped",
    "unused": """select c.* from (select *, row_number() over (partition by job_id, file_path order by place) n from ranked) c
          where n = 1 and not exists (select 1 from kept_draft d where d.job_id = c.job_id and d.file_path = c.file_path)""",
    "timed": """select *, case when file_type='video' then 4000 else 2500 end as len,
          row_number() over (partition by job_id order by place) as k from unused""",
    "added": """select t.*, coalesce(sum(len) over (partition by t.job_id order by place rows between unbounded preceding and 1 preceding), 0) as before_ms from timed t""",
    "filled": f"""select job_id, seq, file_path, file_id, start_offset, end_offset, duration, segment_type, similarity_score, composite_rank, creation_timestamp, nima_aesthetic from kept_draft
        union all
        select a.job_id, coalesce(u.last_seq, -1) + a.k, a.file_path, a.file_id, a.source_offset,
          case when a.file_type='video' then a.source_offset + 4.0 else 0.0 end, a.len / 1000.0::double,
          case when a.file_type='video' then 'video_clip' else 'image' end, a.score, a.composite_rank, a.creation_timestamp, a.nima_aesthetic
        from added a join jobs j using (job_id) left join (
          select job_id, sum({ms('duration')}) as used_ms, max(seq) as last_seq from kept_draft group by 1) u using (job_id)
        where coalesce(u.used_ms, 0) + a.before_ms < j.target_duration * 60000""",
    "tries": "select f.*, i.i as iteration from filled f, (values (1), (2), (3)) i(i) where f.seq % (i.i + 1) <> 0",
    "parts": f"""select job_id, iteration, sum({ms('duration')}) / 1000.0::double as total_duration,
          sqrt(cast(sum({ms('duration')}::hugeint*{ms('duration')}) * count(*) - sum({ms('duration')})::hugeint * sum({ms('duration')}) as double)) / count(*) / 1000.0::double as std,
          {mean('coalesce(nima_aesthetic, 0.5)')} as nima, {mean('coalesce(nullif(similarity_score,0), 0.10)')} as rel,
          count(distinct segment_type) as kinds, count(*) as segments from tries group by 1, 2""",
    "scored": f"""select p.job_id, p.iteration, p.segments, p.total_duration, j.target_duration,
          case when p.total_duration < target_duration then greatest(0.0, p.total_duration / target_duration)
               when p.total_duration > target_duration * 1.25 then greatest(0.0, 1.0 - (p.total_duration - target_duration * 1.25) / target_duration)
               else 1.0 end as duration_score,
          {clip('std','0.2','1.0')} as pacing_score, nima as visual_score, {clip('(rel - 0.05) / 0.18','0.0','1.0')} as relevance_score,
          case when kinds > 1 then 1.0 else 0.7 end as diversity_score from parts p join jobs j using (job_id)""",
    "composites": f"""select *, {rnd('10.0 * (0.25*duration_score + 0.20*pacing_score + 0.25*visual_score + 0.20*relevance_score + 0.10*diversity_score)',2)} as composite_score from scored""",
    # storyboard selection, buckets first
    "viable": """select * exclude (p, n) from (select r.*, j.target_duration, max(score >= 0.08) over (partition by r.job_id) as p,
          row_number() over (partition by r.job_id order by seq) as n from ranked r join jobs j using (job_id)) where score >= 0.08 or (not p and n <= 10)""",
    "spans": """select job_id, min(nullif(creation_timestamp,0)) as lo, max(nullif(creation_timestamp,0)) as hi, count(nullif(creation_timestamp,0)) as timed, count(*) as n from viable group by 1""",
    "grid": """select job_id, case when timed >= 2 then lo else 0.0 end as lo, case when timed >= 2 then hi else 1.0 end as hi,
          cast(case when timed >= 2 then greatest(3, least(15, floor(greatest(1.0, (hi - lo) / 86400.0) * 2))) else greatest(3, least(10, floor(n / 2))) end as integer) as n_buckets from spans""",
    "bucketed": """select v.*, n_buckets, cast(greatest(0, least(n_buckets - 1, floor((coalesce(nullif(creation_timestamp,0), lo) - lo) /
          case when hi > lo then greatest(1.0, (hi - lo + 1.0) / n_buckets) else 1.0 end))) as integer) as bucket from viable v join grid using (job_id)""",
    "clips": f"""select *, {ms("case when file_type='video' then greatest(2.0, least(6.0, case when coalesce(scene_end,0)-coalesce(scene_start,0) > 0 then scene_end-coalesce(scene_start,0) else 4.0 end)) else 2.5 end")} as len,
          row_number() over (partition by job_id, bucket order by coalesce(composite_rank, score) desc, coalesce(creation_timestamp,0), seq) as n from bucketed""",
    "bucket_picks": """select * from (select *, coalesce(sum(len) over (partition by job_id order by bucket rows between unbounded preceding and 1 preceding), 0) as before_ms
          from clips where n = 1) where before_ms < target_duration * 1000""",
    "spare": """select * from (select b.*, row_number() over (partition by b.job_id, b.file_path order by coalesce(composite_rank, score) desc, coalesce(creation_timestamp,0), seq) as k
          from bucketed b where not exists (select 1 from bucket_picks p where p.job_id = b.job_id and p.file_path = b.file_path)) where k = 1""",
    "spare_timed": """select *, case when file_type='video' then 4000 else 2500 end as len, row_number() over (partition by job_id order by coalesce(composite_rank, score) desc, coalesce(creation_timestamp,0), seq) as m from spare""",
    "fill_picks": """select s.* from (select *, coalesce(sum(len) over (partition by job_id order by m rows between unbounded preceding and 1 preceding), 0) as before_ms from spare_timed) s
          left join (select job_id, sum(len) as used_ms from bucket_picks group by 1) u using (job_id)
          where coalesce(u.used_ms, 0) + before_ms < target_duration * 1000""",
    "curated": """select job_id, file_path, file_type, source_offset, creation_timestamp, len, bucket as pick from bucket_picks
        union all select job_id, file_path, file_type, source_offset, creation_timestamp, len, 1000 + m from fill_picks""",
    # catalogue
    "docs": """select doc_id, '/media/' || source || '/' || doc_id || (['.jpg','.png','.mp4','.mov'])[doc_id % 4 + 1] as file_path, n_chars as file_size,
          case when doc_id % 4 < 2 then 'image' else 'video' end as file_type, md5(text) as content_hash, 1700000000.0::double + doc_id * 61 + n_chars as mtime,
          cast((1700000000 + doc_id * 61 + n_chars) * 1000000 as varchar) as micros
        from documents d""",
    "files": """select doc_id + 1 as id, file_path, md5(file_size || '_' || micros) as file_hash, content_hash, file_size, file_type,
          case when doc_id % 3 = 0 then mtime end as creation_timestamp,
          case when doc_id % 9 = 0 then 'ERROR' when doc_id % 23 = 0 then 'SCANNED' else 'INDEXED' end as status,
          case when doc_id % 9 = 0 then 'unreadable' end as error_message,
          case when doc_id % 9 <> 0 and doc_id % 23 <> 0 then 'siglip2' end as model_name,
          case when doc_id % 9 <> 0 and doc_id % 23 <> 0 then '1.0' end as model_version,
          case when doc_id % 29 = 0 then '' else 'p' || doc_id end as point_ids,
          case when doc_id % 9 <> 0 and doc_id % 23 <> 0 then 100.0::double end as embedded_at
        from docs where doc_id % 10 <> 0""",
    "listing": """select file_path, file_size + case when doc_id % 7 = 0 then 1 else 0 end as file_size, file_type, mtime, content_hash,
          md5((file_size + case when doc_id % 7 = 0 then 1 else 0 end) || '_' || micros) as file_hash from docs where doc_id % 11 <> 5""",
    "donors": """select content_hash, id as donor_id, point_ids as donor_points, model_name as donor_model from (
          select *, row_number() over (partition by content_hash order by id) n from files) where n = 1 and status = 'INDEXED' and point_ids <> ''""",
    "classified": """select l.*, f.id as known_id, d.donor_id, d.donor_points, d.donor_model,
          case when f.file_hash = l.file_hash and f.status = 'INDEXED' then 'skip' when f.file_hash = l.file_hash then 'resume'
               when d.donor_id is not null then 'reuse' when f.id is not null then 'modified' else 'new' end as action
        from listing l left join files f on f.file_path = l.file_path left join donors d on d.content_hash = l.content_hash""",
    "removed": "select * from files f where not exists (select 1 from listing l where l.file_path = f.file_path)",
    "media_files": """select file_id as id, file_path, file_type, creation_timestamp, duration_seconds, file_id * 100000 as file_size
        from frames where frame_index = 0 and file_id % 10 <> 9""",
    "board": "select *, row_number() over (partition by job_id order by coalesce(creation_timestamp,0), seq) - 1 as position from filled",
    "compiled": """select b.job_id, b.position, coalesce(case when seq % 2 = 0 then b.file_id end, f.id) as file_id, segment_type, start_offset, duration,
          coalesce(nullif(composite_rank,0), similarity_score) as similarity_score, b.position as time_bucket
        from board b left join media_files f on f.file_path = b.file_path where coalesce(case when seq % 2 = 0 then b.file_id end, f.id) is not null""",
    "frame_index": """select user_id as file_id, row_number() over (partition by user_id order by event_id) - 1 as idx, value,
          case user_id % 5 when 1 then 24.0::double when 2 then 29.97::double when 3 then 2.5::double when 4 then 60.0::double end as src_fps from events""",
    "pixels": """select vec_id as frame_id, cast(p // 8 as integer) as y, cast(p % 8 as integer) as x,
          least(255.0, greatest(0.0, floor(128.0 + 400.0 * cast(embedding[p % 64 + 1] as double)))) as r,
          least(255.0, greatest(0.0, floor(128.0 + 400.0 * cast(embedding[(p + 1) % 64 + 1] as double)))) as g,
          least(255.0, greatest(0.0, floor(128.0 + 400.0 * cast(embedding[(p + 2) % 64 + 1] as double)))) as b
        from embeddings, range(0, 64) t(p)""",
    "greys": "select *, floor(0.299::double*r + 0.587::double*g + 0.114::double*b + 0.5) as grey, abs(r-g) as rg, abs((r+g)*0.5 - b) as yb from pixels",
    "laplacians": """select c.frame_id, var_pop(u.grey + d.grey + l.grey + r.grey - 4 * c.grey) as v from greys c
          join greys u on u.frame_id = c.frame_id and u.x = c.x and u.y = abs(c.y - 1)
          join greys d on d.frame_id = c.frame_id and d.x = c.x and d.y = 7 - abs(7 - (c.y + 1))
          join greys l on l.frame_id = c.frame_id and l.y = c.y and l.x = abs(c.x - 1)
          join greys r on r.frame_id = c.frame_id and r.y = c.y and r.x = 7 - abs(7 - (c.x + 1)) group by 1""",
    "measures": f"""select g.frame_id, {clip('any_value(l.v) / 1200.0','0.0','1.0')} as sharpness,
          {clip('(sqrt(pow(stddev_pop(rg),2) + pow(stddev_pop(yb),2)) + 0.3 * sqrt(pow(avg(rg),2) + pow(avg(yb),2))) / 100.0','0.0','1.0')} as colorfulness,
          {clip('(quantile_cont(grey, 0.95) - quantile_cont(grey, 0.05)) / 220.0','0.0','1.0')} as contrast
        from greys g join laplacians l using (frame_id) group by 1""",
    "shots": """select user_id as job_id, event_id as position, '/m/' || event_id || '.jpg' as file_path,
          case when event_type = 'view' then 'video_clip' else 'image' end as segment_type, value / 20 as duration from events""",
}


def _needed(text: str, done: list[str]) -> None:
    for name in CTES:
        if name not in done and re.search(rf"\b(from|join|,)\s+{name}\b", text):
            _needed(CTES[name], done)
            if name not in done:
                done.append(name)


def _sql(body: str) -> str:
    names: list[str] = []
    _needed(body, names)
    if not names:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in names) + "\n" + body


ORACLE_BODIES: dict[str, str] = {}


def _weights(profile: str, signals: list[str]) -> dict[str, float]:
    chosen = {s: PROFILES[profile]["weights"][s] for s in signals}
    total = sum(chosen.values())
    return {s: w / total for s, w in chosen.items()}


def _strategy(weights: tuple[float, ...]) -> str:
    total = sum(weights)
    values = [COS_NORM, NIMA, SHARP, CONT, COLOR, TECH]
    return rnd(" + ".join(f"cast({w / total!r} as double)*{v}" for w, v in zip(weights, values)), 4)


_mime = " ".join(f"when '{s}' then '{t}'" for s, t in MIME_BY_SUFFIX.items())
_edges = ", ".join(f"'{a}>{b}'" for a, targets in ALLOWED_TRANSITIONS.items() for b in targets)
_hit = "query_id, rank, point_id, score"


def _topk(points: str, queries: str, k: int, where: str = "true", floor: str = "true") -> str:
    score = rnd(cosine("p.vector", "q.query_vector"), 8)
    return f"""select {_hit} from (select q.query_id, p.point_id, {score} as score,
        row_number() over (partition by q.query_id order by {score} desc, p.point_id) as rank
        from {points} p, {queries} q where {where}) where rank <= {k} and {floor}"""


ORACLE_BODIES.update({
    "mime_type": f"select file_path, case '.' || split_part(file_path, '.', -1) {_mime} end as mime_type from listing",
    "sniffed_type": """select doc_id, case doc_id % 5 when 0 then 'image' when 1 then 'image' when 2 then 'image' when 3 then 'video'
        else case doc_id % 3 when 0 then 'video' when 1 then 'image' end end as file_type from documents
        where not (doc_id % 5 = 4 and doc_id % 3 = 2)""",
    "fast_hash": "select doc_id, md5(n_chars || '_' || (1700000000 + doc_id * 61 + n_chars) * 1000000) as file_hash from documents",
    "content_hash": "select doc_id, md5(text) as content_hash from documents",
    "live_photo_pairs": """with named as (select distinct '/m/' || (doc_id // 3) as stem, (['.HEIC','.mov','.jpg','.MOV','.png','.mp4','.txt'])[doc_id % 7 + 1] as ext from documents),
        videos as (select *, row_number() over (partition by stem order by case ext when '.MOV' then 1 when '.mov' then 2 when '.mp4' then 3 else 4 end) n from named where ext in ('.MOV','.mov','.mp4','.MP4'))
        select s.stem || s.ext as still_path, v.stem || v.ext as companion_path from named s join videos v on v.stem = s.stem and v.n = 1
        where lower(s.ext) in ('.heic','.heif','.jpg','.jpeg','.png')""",
    "removed_files": "select id, file_path, cast(case when point_ids = '' then 0 else 1 end as integer) as points from removed",
    "removed_points": "select id, point_ids as point_id from removed where point_ids <> ''",
    "kept_files": "select id, file_path, status from files f where exists (select 1 from listing l where l.file_path = f.file_path)",
    "cascade_timeline": """select cast(e.user_id as varchar) as job_id, e.event_id as position, e.event_id % 1500 as file_id from events e
        where e.event_id % 1500 in (select f.id from files f where exists (select 1 from listing l where l.file_path = f.file_path))""",
    "classify": "select file_path, action, donor_id from classified",
    "classify_forced": """select l.file_path, d.donor_id, case when d.donor_id is not null then 'reuse' when f.id is not null and f.file_hash <> l.file_hash then 'modified' else 'new' end as action
        from listing l left join files f on f.file_path = l.file_path left join donors d on d.content_hash = l.content_hash""",
    "content_donors": "select content_hash, donor_id from donors",
    "upsert_files": """select f.id, coalesce(f.file_path, l.file_path) as file_path, coalesce(l.file_hash, f.file_hash) as file_hash,
          coalesce(case when l.file_size % 2 = 0 then l.content_hash end, f.content_hash) as content_hash, coalesce(l.file_size, f.file_size) as file_size,
          coalesce(case when l.file_size % 5 = 0 then l.mtime end, f.creation_timestamp) as creation_timestamp,
          case when l.file_path is not null then 'SCANNED' else f.status end as status, f.error_message, f.model_name,
          case when f.file_path is null then 200.0::double else 50.0::double end as scanned_at,
          case when l.file_path is null then 100.0::double else 200.0::double end as updated_at
        from files f full join listing l on l.file_path = f.file_path""",
    "apply_scan": """select c.file_path, c.file_hash, case c.action when 'reuse' then 'INDEXED' when 'modified' then 'SCANNED' when 'new' then 'SCANNED' else f.status end as status,
          case when c.action = 'reuse' then c.donor_points else f.point_ids end as point_ids,
          case when c.action = 'reuse' then c.donor_model else f.model_name end as model_name,
          case when f.id is null then 200.0::double else 50.0::double end as scanned_at,
          case when c.action in ('reuse','modified','new') then 200.0::double else 100.0::double end as updated_at
        from classified c left join files f on f.file_path = c.file_path""",
    "assign_ids": """select file_path, 100000 + row_number() over (order by substr(md5(file_path), 1, 3), file_path) as id
        from listing l where not exists (select 1 from files f where f.file_path = l.file_path)""",
    "select_for_processing": "select id, status from files where status <> 'INDEXED'",
    "by_status": "select id, file_path, error_message from files where status = 'ERROR'",
    "lookup": "select id, file_path, 'path' as found_by from files where file_path = '/media/src1/1.png' union all select id, file_path, 'id' from files where id = 4",
    "all_files": "select id, file_path, file_size, status from files",
    "mark_indexed": """with p as (select user_id * 2 as id, string_agg(distinct 'e' || event_type, ',' order by 'e' || event_type) as ids from events group by 1)
        select f.id, case when p.id is not null then 'INDEXED' else status end as status, case when p.id is not null then '2.0' else model_version end as model_version,
          coalesce(p.ids, f.point_ids) as point_ids, case when p.id is not null then 300.0::double else embedded_at end as embedded_at,
          case when p.id is not null then 300.0::double else 100.0::double end as updated_at from files f left join p on p.id = f.id""",
    "link_points": """with p as (select distinct user_id * 2 as file_id, 'e' || event_type as point_id from events)
        select * from p union all select id, point_ids from files where point_ids <> '' and id not in (select file_id from p)""",
    "mark_linked": """with p as (select distinct user_id * 2 as id from events)
        select f.id, case when p.id is not null then 'INDEXED' else status end as status, case when p.id is not null then '2.0' else model_version end as model_version,
          case when p.id is not null then 300.0::double else embedded_at end as embedded_at, case when p.id is not null then 300.0::double else 100.0::double end as updated_at
        from files f left join p on p.id = f.id""",
    "removed_links": "select id, file_path, point_ids as point_id from removed where point_ids <> ''",
    "linked_donors": "select content_hash, donor_id from donors",
    "donate_links": """with r as (select known_id as id, donor_id, donor_points from classified where action = 'reuse' and known_id is not null and known_id <> donor_id)
        select id as file_id, point_ids as point_id from files where point_ids <> '' and id not in (select id from r) union all select id, donor_points from r""",
    "mark_errors": """select id, case when id % 13 = 0 then 'ERROR' else status end as status, case when id % 13 = 0 then 'cannot decode ' || file_path else error_message end as error_message,
          case when id % 13 = 0 then 300.0::double else 100.0::double end as updated_at from files""",
    "update_status": """select id, case when status = 'ERROR' then 'PENDING' else status end as status, case when status = 'ERROR' then null else error_message end as error_message,
          case when status = 'ERROR' then 300.0::double else 100.0::double end as updated_at from files""",
    "reset_embeddings": """select id, case when status = 'INDEXED' then 'SCANNED' else status end as status, case when status <> 'INDEXED' then model_name end as model_name,
          cast(case when status = 'INDEXED' or point_ids = '' then 0 else 1 end as integer) as points, case when status <> 'INDEXED' then embedded_at end as embedded_at, creation_timestamp,
          case when status = 'INDEXED' then 300.0::double else 100.0::double end as updated_at from files""",
    "stats": """select 'total' as "grouping", '' as value, count(*) as files, cast(coalesce(sum(file_size),0) as bigint) as bytes from files
        union all select 'status', status, count(*), cast(sum(file_size) as bigint) from files group by status
        union all select 'file_type', file_type, count(*), cast(sum(file_size) as bigint) from files group by file_type""",
    "transition_audit": f"""with log as (select user_id as file_id, cast(event_id as double) as changed_at,
          case event_type when 'signup' then 'PENDING' when 'view' then 'SCANNED' when 'click' then 'EMBEDDED' when 'purchase' then 'INDEXED' else 'ERROR' end as status from events),
        l2 as (select *, lag(status) over (partition by file_id order by changed_at) as from_status from log)
        select file_id, changed_at, from_status, status from l2 where from_status is not null and from_status || '>' || status not in ({_edges})""",
    "check_unique": "select content_hash, count(*) as rows from files group by 1 having count(*) > 1",
    "set_meta": """with e as (select cast(user_id as varchar) as key, props as value, cast(event_id as double) as updated_at from events),
        all_rows as (select *, 0 as fresh from e where updated_at % 10 = 0 union all select *, 1 from e where updated_at % 10 <> 0)
        select key, value, updated_at from (select *, row_number() over (partition by key order by fresh desc, updated_at desc) n from all_rows) where n = 1""",
    "scan_summary": """select count(*) as total_found, count(*) filter (action = 'new') as new_files, count(*) filter (action = 'modified') as modified_files,
          count(*) filter (action = 'skip') as skipped_files, count(*) filter (action = 'reuse') as reused_files,
          count(*) filter (file_type = 'image') as images_count, count(*) filter (file_type = 'video') as videos_count,
          (select count(*) from removed) as deleted_files from classified""",
    "capture_time": """select event_id, case when event_id % 3 = 0 or event_id % 5 = 0 or event_id % 7 = 0 then epoch(date_trunc('second', ts)) else 5.0::double end as creation_timestamp,
          case when event_id % 3 = 0 or event_id % 5 = 0 or event_id % 7 = 0 then 'exif' else 'filesystem' end as timestamp_source from events""",
    "workspace_info": """with f as (select id % 3 as workspace_id, count(*) n, count(*) filter (status = 'INDEXED') i from files group by 1),
        p as (select file_id % 4 as workspace_id, count(*) v from points group by 1)
        select coalesce(f.workspace_id, p.workspace_id) as workspace_id, coalesce(n, 0) as total_files, coalesce(i, 0) as indexed_files, coalesce(v, 0) as total_vectors
        from f full join p on p.workspace_id = f.workspace_id""",
    "sample_frames": f"""with k as (select *, case when src_fps > 0 then greatest(1, cast(round_even(src_fps, 0) as bigint)) else 30 end as every from frame_index)
        select file_id, idx, no as frame_no, {rnd('case when src_fps > 0 then idx / src_fps else cast(no as double) end',3)} as source_offset
        from (select *, row_number() over (partition by file_id order by idx) - 1 as no from k where idx % every = 0)""",
    "preview_frames": """with c as (select distinct file_id, (file_id % 3) / 2.0::double as start_offset, (file_id % 5) * 0.7::double as duration, coalesce(src_fps, 30.0) as fps from frame_index),
        w as (select *, cast(trunc(greatest(1.0, least(10.0, duration)) * 12) as bigint) as n, greatest(1, cast(trunc(fps / 12) as bigint)) as step,
          cast(ceil(greatest(0.0, start_offset) * fps) as bigint) as first from c)
        select w.file_id as clip_id, (f.idx - w.first) // w.step as frame_no, f.idx from w join frame_index f on f.file_id = w.file_id
        where f.idx >= w.first and (f.idx - w.first) % w.step = 0 and (f.idx - w.first) // w.step < w.n""",
    "cut_candidates": f"""with c as (select file_id, idx, abs(value - lag(value) over (partition by file_id order by idx)) as change from frame_index),
        l as (select a.file_id, a.idx, any_value(a.change) as change, avg(b.change) as local from c a join c b on b.file_id = a.file_id and b.idx between a.idx - 2 and a.idx + 2 and b.idx <> a.idx group by 1, 2)
        select file_id, idx as frame_index, {rnd('change',6)} as change, {rnd('local',6)} as local from l where change > 0 and change / greatest(local, 1e-9) >= 3.0""",
    "tag_scene": "select vec_id, scene_id, scene_start, scene_end from tagged where file_type = 'video'",
    "scene_representatives": """select point_id, file_id, scene_id, frame_index, source_offset, scene_start, scene_end, scene_frame_count, nima_aesthetic, sharpness, technical_composite from scene_points""",
    "scene_vectors": f"select point_id, cast(i - 1 as integer) as i, {rnd('cast(vector[i] as double)',5)} as x from scene_points, range(1, 65) t(i)",
    "l2_normalize": f"""with s as (select vec_id, list_transform(embedding, lambda x: case when vec_id % 50 <> 0 then cast(x as double) * (label + 1) else 0.0::double end) as v from embeddings),
        n as (select *, sqrt(list_dot_product(v, v)) as norm from s)
        select vec_id, cast(i - 1 as integer) as i, {rnd('case when norm > 0 then v[i] / norm else v[i] end',8)} as x from n, range(1, 65) t(i)""",
    "measure_frames": f"select frame_id, {rnd('sharpness',9)} as sharpness, {rnd('colorfulness',9)} as colorfulness, {rnd('contrast',9)} as contrast from measures",
    "technical_composite": f"""select frame_id, {rnd('sharpness',4)} as sharpness, {rnd('colorfulness',4)} as colorfulness, {rnd('contrast',4)} as contrast,
          {rnd('0.50*sharpness + 0.15*colorfulness + 0.35*contrast',4)} as technical_composite from measures""",
    "aesthetic_from_distribution": f"""with p as (select vec_id, list_transform(embedding[1:10], lambda x: exp(cast(x as double) * 8)) as w from embeddings),
        s as (select vec_id, list_sum(w) as total, list_sum(list_transform(range(1, 11), lambda i: w[i] * i)) as weighted from p)
        select vec_id, case when vec_id % 50 = 1 then 0.5 when vec_id % 7 = 0 then 0.4321 else {rnd(clip('(weighted / total - 1.0) / 9.0','0.0','1.0'),4)} end as nima_aesthetic from s""",
    "epic_composite": f"""select vec_id, {rnd('0.55*nima_aesthetic + 0.45*technical_composite',4)} as epic_composite from frames""",
    "prompt_text": """select doc_id, case doc_id % 4 when 0 then 'a photo of ' || rtrim(text, ' ') when 1 then 'a video of ' || rtrim(text, ' ') else 'a photo of ' || trim(text, ' ') end as prompt from documents""",
    "build_points": "select point_id, file_path, granularity, frame_index, source_offset, scene_id, is_scene_representative, scene_frame_count, nima_aesthetic, sharpness, technical_composite from points",
    "search_topk": _topk("points", "queries", 10, "q.query_id = 3"),
    "search_threshold": _topk("points", "queries", 25, floor="score >= 0.15"),
    "search_filtered": _topk("points", "queries", 5, "p.creation_timestamp between 1704200000 and 1704900000 and p.file_type='video' and p.granularity='frame' and p.scene_id = 1"),
    "filter_points": "select point_id, file_path, creation_timestamp from points where creation_timestamp >= 1704200000 and granularity='scene' and is_scene_representative",
    "exclude_paths": """with p as (select point_id, case when file_id % 5 <> 0 then file_path end as file_path from points)
        select point_id, file_path from p where file_path is null or not exists (select 1 from frames f where f.label = 4 and f.file_path = p.file_path)""",
    "search_many": _topk("points", "(select vec_id as query_id, embedding as query_vector from embeddings)", 10),
    "similar_to": f"""select source_id, rank, point_id, score from (select s.point_id as source_id, p.point_id, {rnd(cosine('p.vector','s.vector'),8)} as score,
          row_number() over (partition by s.point_id order by {rnd(cosine('p.vector','s.vector'),8)} desc, p.point_id) as rank
        from points p, points s where p.granularity='frame' and s.granularity='scene' and p.point_id <> s.point_id) where rank <= 5""",
    "get_point": f"""select point_id, file_path, granularity, 1.0::double as score, {rnd('list_sum(list_transform(vector, lambda x: cast(x as double)))',5)} as vector_sum
        from points where file_path = '/media/v16.mp4' and scene_id = 1 and granularity = 'scene'""",
    "points_by_file": "select point_id, granularity, source_offset, frame_index, 1.0::double as score from points where file_path = '/media/v16.mp4'",
    "scene_list": f"""select file_path, scene_id, scene_start as start_sec, coalesce(scene_end, duration_seconds, 0.0) as end_sec, {rnd('scene_end - scene_start',2)} as duration_sec, scene_frame_count as frame_count
        from points where granularity = 'scene'""",
    "scene_breakdown": """select file_path, count(*) filter (granularity='scene') as total_scenes, count(*) filter (granularity<>'scene') as total_frames,
          coalesce(round(sum(case when granularity='scene' then scene_end - scene_start end), 2), 0.0) as scene_seconds from points group by 1""",
    "scene_list": f"""select file_path, coalesce(scene_id, 0) as scene_id, point_id, coalesce(scene_start, 0.0) as start_sec, coalesce(scene_end, duration_seconds, 0.0) as end_sec,
          {rnd('coalesce(scene_end, 0.0) - coalesce(scene_start, 0.0)',2)} as duration_sec, coalesce(scene_frame_count, 0) as frame_count from points where granularity = 'scene'""",
    "frame_list": "select file_path, point_id, frame_index, source_offset, scene_id from points where granularity <> 'scene'",
    "upsert_points": "select point_id, file_path, case when file_id % 3 = 0 then file_type || '-new' else file_type end as file_type from points",
    "delete_points": "select point_id, granularity from points where not (coalesce(scene_id, -1) = 0 and granularity = 'frame')",
    "delete_by_path": "select point_id, file_path from points where file_path <> '/media/v16.mp4'",
    "pair_similarity": f"""select l.vec_id, case when r.vec_id % 9 = 0 then 0.0 else {rnd('list_dot_product(l.embedding::double[], r.embedding::double[])',4)} end as similarity
        from embeddings l join embeddings r on r.vec_id = l.vec_id + 1""",
    "similarity_band": f"""with e as (select vec_id, {rnd('cast(embedding[1] as double)',4)} as similarity from embeddings)
        select vec_id, similarity, case when similarity >= 0.08 then 'strong' when similarity >= 0.03 then 'moderate' when similarity >= 0 then 'weak' else 'negative' end as band,
          {rnd('(greatest(-0.15, least(0.15, similarity)) + 0.15) / 0.30 * 100.0',4)} as gauge_pct from e""",
    "reference_vector": f"""select query_id as label, cast(i - 1 as integer) as i, {rnd('query_vector[i] / sqrt(list_dot_product(query_vector, query_vector))',8)} as x from queries, range(1, 65) t(i)""",
    "near_duplicates": f"""with i as (select label, point_id, vector, floor(contrast*1e4+0.5) as s from frames)
        select a.point_id, exists (select 1 from i b where b.label = a.label and (b.s > a.s or (b.s = a.s and b.point_id < a.point_id)) and {cosine('a.vector','b.vector')} > 0.25) as is_duplicate from i a""",
    "near_duplicate_hashes": """with i as (select file_type, point_id, floor(contrast*1e4+0.5) as s,
          xor(cast('0x' || substr(md5(cast(vec_id // 4 as varchar)), 1, 15) as bigint), (cast(1 as bigint) << (vec_id % 3)) + (cast(1 as bigint) << (vec_id % 41))) as h from frames)
        select a.point_id, exists (select 1 from i b where b.file_type = a.file_type and (b.s > a.s or (b.s = a.s and b.point_id < a.point_id)) and bit_count(xor(a.h, b.h)) < 5) as is_duplicate from i a""",
    "retrieve": "select job_id, query_idx, pass, rank, point_id, score, seq from seq_hits",
    "merge_candidates": "select job_id, candidate_key, point_id, score, seq from merged",
    "normalize_cosine": f"select job_id, candidate_key, {rnd(COS_NORM,6)} as cos_norm from merged",
    "composite_rank": "select job_id, candidate_key, composite_rank from composed",
    "epic_similarity": "",
    "order_candidates": """with z as (select * replace (case when seq % 5 <> 0 then composite_rank else 0.0 end as composite_rank) from composed)
        select job_id, candidate_key, row_number() over (partition by job_id order by """ + RANK_VALUE + """ desc, seq) as place from z""",
    "min_score_filter": """with z as (select * replace (case when job_id = 'job1' then score * 0.01 else score end as score) from composed),
        n as (select *, max(score >= 0.08) over (partition by job_id) as p, row_number() over (partition by job_id order by """ + RANK_VALUE + """ desc, seq) as n from z)
        select job_id, candidate_key, composite_rank from n where score >= 0.08 or (not p and n <= 10)""",
    "cap_per_file": "select job_id, file_path, candidate_key from (select *, row_number() over (partition by job_id, file_path order by " + RANK_VALUE + " desc, seq) n from composed) where n = 1",
    "rank_candidates": "select job_id, place, candidate_key, composite_rank, score from ranked",
    "rerank": f"""select job_id, candidate_key, {_strategy(PRESETS['clarity'])} as composite_rank, {rnd(COS_NORM,3)} as cos_norm, {rnd(SHARP,3)} as sharp_val, {rnd(TECH,3)} as tech_val, {rnd(SHARP,3)} as sort_value from merged""",
    "filter_by_name": "select job_id, candidate_key from merged where lower(split_part(file_path, '/', -1)) like '%v1%'",
    "compare_strategies": "with s as (" + " union all ".join(f"select job_id, candidate_key, seq, '{n}' as strategy, {_strategy(w)} as v from merged" for n, w in PRESETS.items())
        + "), r as (select *, row_number() over (partition by job_id, strategy order by v desc, seq) as rank from s) select job_id, rank, "
        + ", ".join(f"max(candidate_key) filter (strategy = '{n}') as {n}" for n in PRESETS) + " from r where rank <= 10 group by 1, 2",
    "diversity_penalty": f"""with v as (select r.*, p.vector as pv from ranked r join points p using (point_id)),
        c as (select a.job_id, a.candidate_key, a.composite_rank, count(b.place) as n from v a left join v b on b.job_id = a.job_id and b.place < a.place and {cosine('a.pv','b.pv')} > 0.3 group by 1, 2, 3)
        select job_id, candidate_key, n as similar_before, {rnd('composite_rank * pow(0.5, n)',8)} as adjusted_rank from c""",
    "retrieval_report": """select q.job_id, q.query_idx, count(*) filter (h.pass = 0) as matched_scenes, count(*) filter (h.pass = 1) as matched_frames
        from (select 'job' || (query_id % 3) as job_id, query_id as query_idx from queries) q
        left join hits h on h.job_id = q.job_id and h.query_idx = q.query_idx and h.query_idx % 4 <> 1 group by 1, 2""",
    "retrieval_summary": """with e as (select job_id, count(*) as n from ranked where job_id <> 'job2' group by 1),
        o as (select job_id, case when count(*) filter (score >= 0.08) > 0 then count(*) filter (score < 0.08) else greatest(count(*) - 10, 0) end as gone
          from composed where job_id <> 'job2' group by 1)
        select job_id, coalesce(e.n, 0) as total_candidates, coalesce(o.gone, 0) as filtered_out_low_score, 0.08::double as min_score_threshold, signal, weight
        from jobs left join e using (job_id) left join o using (job_id), (values ('cosine', 0.45::double), ('nima', 0.45::double), ('technical', 0.1::double)) w(signal, weight)""",
    "filter_report": """select job_id, count(*) as candidates, case when count(*) filter (score >= 0.08) > 0 then count(*) filter (score < 0.08) else greatest(count(*) - 10, 0) end as filtered_out_low_score from composed group by 1""",
    "time_buckets": "select job_id, candidate_key, bucket, n_buckets from bucketed",
    "bucket_best": """select job_id, bucket, file_path, len / 1000.0::double as duration, case when file_type='video' then source_offset else 0.0 end as start_offset,
          case when file_type='video' then source_offset + len / 1000.0::double else 0.0 end as end_offset, case when file_type='video' then 'video_clip' else 'image' end as segment_type from bucket_picks""",
    "fill_to_target": """select job_id, file_path, len / 1000.0::double as duration, case when file_type='video' then source_offset else 0.0 end as start_offset,
          case when file_type='video' then source_offset + len / 1000.0::double else 0.0 end as end_offset, case when file_type='video' then 'video_clip' else 'image' end as segment_type from fill_picks""",
    "segment_duration": """with d as (select *, case when file_type='video' then greatest(2.0, least(6.0, case when coalesce(scene_end - scene_start, 0) > 0 then scene_end - scene_start else 4.0 end)) else 2.5 end as d from merged)
        select candidate_key, job_id, file_path, d as duration, case when file_type='video' then source_offset else 0.0 end as start_offset,
          case when file_type='video' then source_offset + d else 0.0 end as end_offset, case when file_type='video' then 'video_clip' else 'image' end as segment_type from d""",
    "curate": """select row_number() over (partition by job_id order by coalesce(creation_timestamp,0), pick) - 1 as position, job_id, file_path, len / 1000.0::double as duration,
          case when file_type='video' then source_offset else 0.0 end as start_offset, case when file_type='video' then source_offset + len / 1000.0::double else 0.0 end as end_offset,
          case when file_type='video' then 'video_clip' else 'image' end as segment_type from curated""",
    "one_time_per_file": """with t as (select *, case when seq % 3 = 0 then coalesce(creation_timestamp, 0) + 5 else creation_timestamp end as seen_at from composed)
        select job_id, file_path, count(distinct coalesce(seen_at, 0)) as times from t group by 1, 2 having count(distinct coalesce(seen_at, 0)) > 1""",
    "one_time_enforced": """with t as (select *, case when seq % 3 = 0 then coalesce(creation_timestamp, 0) + 5 else creation_timestamp end as seen_at from composed)
        select job_id, candidate_key, min(seen_at) over (partition by job_id, file_path) as creation_timestamp from t""",
    "draft_dedupe": """select job_id, seq, file_path, file_id, similarity_score, composite_rank, creation_timestamp,
          cast(2 + (nima_aesthetic is not null)::int + (sharpness is not null)::int + (technical_composite is not null)::int as integer) as score_count from deduped""",
    "autofill": "select job_id, seq, file_path, duration, start_offset, end_offset, segment_type from filled",
    "tail_trim": """with r as (select d.*, coalesce(nullif(composite_rank,0), nullif(similarity_score,0), 0.0) as rv from deduped d),
        w as (select *, coalesce(sum(duration) over (partition by job_id order by rv, seq rows between unbounded preceding and 1 preceding), 0) as gone,
          row_number() over (partition by job_id order by rv, seq) - 1 as k, sum(duration) over (partition by job_id) as total, count(*) over (partition by job_id) as n from r)
        select job_id, seq, file_path, duration from w join jobs using (job_id) where not (total - gone > target_duration * 1.25 and n - k > min_segments)""",
    "segment_limits": """with t as (select event_id, event_id % 296 + 5 as t, (case event_id % 3 when 0 then 0.8 when 1 then 1.2 else 1.0 end)::double as f from events),
        m as (select *, greatest(4, cast(trunc((t // 4) * f) as bigint)) as lo from t)
        select event_id, cast(lo as integer) as min_segments, cast(greatest(lo + 4, cast(trunc((t // 2) * f) as bigint)) as integer) as max_segments from m""",
    "chronological": "select job_id, position, file_path from board",
    "score_storyboard": "select job_id, iteration, segments, " + ", ".join(f"{rnd(c,6)} as {c}" for c in
        ("total_duration", "duration_score", "pacing_score", "visual_score", "relevance_score", "diversity_score", "composite_score")) + " from composites",
    "editor_notes": """select job_id, iteration, case when total_duration < target_duration then 'too short' when total_duration > target_duration * 1.25 then 'too long' end as note,
          total_duration between target_duration and target_duration * 1.25 and composite_score >= 7.5 and iteration <> 2 as approved from composites""",
    "best_draft": """select job_id, iteration as best_iteration, composite_score as best_composite_score, n as iterations from (
          select *, row_number() over (partition by job_id order by composite_score desc, iteration desc) as k, max(iteration) over (partition by job_id) as n from composites) where k = 1""",
    "segment_merge": """with v as (select distinct job_id, file_path, source_offset from hits where file_type = 'video'),
        g as (select *, case when source_offset - lag(source_offset) over w < 4.0 then 0 else 1 end as o from v window w as (partition by job_id, file_path order by source_offset)),
        s as (select *, sum(o) over (partition by job_id, file_path order by source_offset) - 1 as segment_no from g)
        select job_id, file_path, cast(segment_no as bigint) as segment_no, greatest(0.0, min(source_offset) - 0.5) as start_offset, 3.0::double as duration, count(*) as merged_hits from s group by 1, 2, 3""",
    "bucket_quota": f"""with span as (select min(creation_timestamp) as lo, max(creation_timestamp) as hi from points),
        b as (select p.*, (select count(*) from range(1, 6) t(i) where p.creation_timestamp >= lo + i * ((hi - lo) / 6)) as bucket from points p, span where creation_timestamp <= hi),
        s as (select q.query_id, b.bucket, b.point_id, {rnd(cosine('b.vector','q.query_vector'),8)} as score from b, queries q),
        r as (select *, row_number() over (partition by query_id, bucket order by score desc, point_id) n from s where score >= 0.22)
        select q.query_id, cast(r.bucket as integer) as bucket, r.point_id, r.score, 15.0::double as quota, r.point_id is null as zero_matches from queries q left join (select * from r where n <= 50) r using (query_id)""",
    "compile_timeline": "select job_id, position, file_id, segment_type, start_offset, duration, similarity_score, time_bucket from compiled",
    "load_timeline": "select job_id, position, file_id, duration from compiled where job_id = 'job1'",
    "timelines_with_files": """select c.job_id, c.position, split_part(f.file_path, '/', -1) as file_name, f.file_type, c.segment_type, c.duration, f.duration_seconds as total_duration
        from compiled c join media_files f on f.id = c.file_id""",
    "edit_list": f"""with c as (select *, case when segment_type = 'video_clip' then greatest(1.5, least(10.0, duration)) else greatest(1.0, least(2.5, duration)) end as len from shots),
        f as (select *, least(0.5, len * 0.4) as fade from c)
        select job_id, position, {rnd('len',5)} as clip_seconds, {rnd(rnd('fade',6),5)} as fade_out,
          {rnd("coalesce(sum(cast(floor(greatest(0.1, len - fade)*1e6+0.5) as bigint)) over (partition by job_id order by position rows between unbounded preceding and 1 preceding), 0) / 1e6",3)} as starts_at,
          {rnd("sum(cast(floor(len*1e6+0.5) as bigint)) over (partition by job_id) / 1e6",3)} as total_seconds from f""",
    "dominant_resolution": """with s as (select user_id as job_id, (event_id % 4 * 1300 >= 3840 or cast(trunc(value * 10) as integer) >= 2160) as big from events)
        select job_id, count(*) filter (big) as large_sources, count(*) as sources, cast(case when count(*) filter (big) > count(*) / 2 then 3840 else 1920 end as integer) as out_width,
          cast(case when count(*) filter (big) > count(*) / 2 then 2160 else 1080 end as integer) as out_height from s group by 1""",
    "inventory": f"""with r as (select c.*, f.file_path, f.file_size, start_offset + c.position % 5 * 0.7::double as spot from (select *, row_number() over (partition by job_id order by position) as segment_index from compiled) c left join media_files f on f.id = c.file_id),
        n as (select r.*, p.point_id, p.contrast, row_number() over (partition by r.job_id, r.position order by abs(p.source_offset - spot), p.source_offset, case p.granularity when 'scene' then 0 else 1 end, p.frame_index) as k
          from r left join points p on p.file_path = r.file_path)
        select job_id, position, segment_index, coalesce(split_part(file_path, '/', -1), 'unknown') as file_name, case when segment_type = 'video_clip' or file_path like '%.mp4' then 'video' else 'photo' end as media_type,
          case when segment_type = 'video_clip' then greatest(1.5, least(10.0, duration)) else greatest(1.0, least(5.0, duration)) end as effective_seconds,
          {rnd('nullif(file_size,0) / 1048576.0::double',2)} as file_size_mb,
          case when not (segment_type = 'video_clip' or coalesce(file_path,'') like '%.mp4') then (['zoom_in','pan_right','zoom_out','pan_left'])[(segment_index - 1) % 4 + 1] end as motion,
          point_id as nearest_point_id, contrast from n where k = 1""",
    "chronology_audit": """with t as (select c.job_id, c.position, f.creation_timestamp as ts from compiled c join media_files f on f.id = c.file_id where coalesce(f.creation_timestamp, 0) <> 0),
        l as (select job_id, ts >= lag(ts) over (partition by job_id order by position) as ok from t),
        a as (select job_id, bool_and(coalesce(ok, true)) as ok from l group by 1)
        select j.job_id, coalesce(a.ok, true) as is_chronological from (select distinct job_id from compiled) j left join a using (job_id)""",
    "duration_audit": """with t as (select job_id, count(*) as n, sum(cast(floor(duration*1000.0+0.5) as bigint)) / 1000.0::double as s from compiled group by 1)
        select j.job_id, target_duration, coalesce(n, 0) as segments, coalesce(s, 0.0) as total_duration, coalesce(s, 0) between target_duration and target_duration * 1.25 as within_bounds from jobs j left join t using (job_id)""",
    "motion_plan": """with s as (select event_id as position, case when event_id % 6 <> 0 then (user_id + 50) / 100.0::double end as a, value % 1.0 as x from events)
        select position, case when a >= 1.4 and x < 0.42 then 'pan_left' when a >= 1.4 and x > 0.58 then 'pan_right' when a >= 1.4 then 'zoom_out'
          when a < 1.2 and x between 0.4 and 0.6 then 'zoom_in' when a < 1.2 then 'zoom_out' else (['zoom_in','pan_right','zoom_out','pan_left'])[position % 4 + 1] end as motion from s""",
    "progress": f"""with g as (select cast(user_id as varchar) as job_id, event_type as stage, max(cast(floor(value) as bigint)) as processed, max(case when user_id % 11 = 0 then 0 else 500 end) as total,
          max(epoch(ts)) - min(epoch(ts)) as el from events group by 1, 2)
        select job_id, stage, processed, cast(total as bigint) as total, {rnd('case when total > 0 then processed / total::double * 100.0 else 100.0 end',4)} as percentage,
          {rnd('case when el > 0 then processed / el else 0.0 end',6)} as files_per_second, {rnd('el',3)} as elapsed_seconds from g""",
    "latest_job_state": f"""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k, count(*) over (partition by user_id) n from events),
        s as (select *, case event_type when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' else 'RUNNING' end as status from r where k = 1)
        select cast(user_id as varchar) as job_id, status, event_type as stage, {rnd('least(100.0, value)',1)} as progress_pct, event_id as event_no, n as events,
          status = 'RUNNING' and 1706659200.0 - epoch(ts) >= 15 as needs_check from s""",
    "telemetry_rollup": f"""select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, count(*) as samples,
          {rnd(mean('user_id'),6)} as avg_decode_qsize, {rnd(mean('user_id % 7'),6)} as avg_index_qsize, {rnd(mean('value'),6)} as avg_cpu_percent,
          {rnd(mean('value * 2'),6)} as avg_memory_rss_mb, {rnd(mean('value / 4'),6)} as avg_system_cpu_percent, {rnd(mean('user_id % 100'),6)} as avg_system_ram_percent,
          max(user_id) as max_decode_qsize, max(user_id % 7) as max_index_qsize, max(value) as max_cpu_percent, max(value * 2) as max_memory_rss_mb,
          max(value / 4) as max_system_cpu_percent, max(cast(user_id % 100 as double)) as max_system_ram_percent
          from events where event_type <> 'signup' group by 1""",
    "telemetry_runs": """with r as (select *, 'host' || event_id % 5 as source,
          sum(case when event_type = 'signup' then 1 else 0 end) over (partition by event_id % 5 order by ts, event_id) as run_id from events)
        select source, cast(run_id as bigint) as run_id, count(*) as samples, min(epoch(ts)) as first_sample, max(epoch(ts)) as last_sample,
          max(user_id) as max_decode_qsize, max(user_id % 7) as max_index_qsize, max(value) as max_cpu_percent, max(value * 2) as max_memory_rss_mb,
          max(value / 4) as max_system_cpu_percent, max(cast(user_id % 100 as double)) as max_system_ram_percent
        from r where event_type <> 'signup' group by 1, 2""",
    "stage_latency": f"""with s as (select cast(event_id as varchar) as job_id, 0 as n, upper(event_type) as node, event_type as stage, value as secs, props as summary from events
          union all select cast(event_id as varchar), 1, 'EDITOR', 'editing', value / 2, event_type from events
          union all select cast(event_id as varchar), 2, upper(event_type), event_type, value, props from events)
        select job_id, node, stage, count(*) as runs, {rnd(total('secs') + '/1e8',4)} as total_seconds, {rnd('max(secs)',4)} as slowest_seconds, arg_max(summary, n) as last_summary from s group by 1, 2, 3""",
})
del ORACLE_BODIES["epic_similarity"]
ORACLE_BODIES["measure_pixels"] = ORACLE_BODIES["measure_frames"]
ORACLE_BODIES["search_many_blocks"] = ORACLE_BODIES["search_many"]

_ew = _weights("cinematic", ["cosine", "epic_sim"])
ORACLE_BODIES["epic_similarity"] = f"""with r as (select 'job' || query_id as job_id, query_vector as rv from queries where query_id < 3),
    e as (select m.*, coalesce({clip('((list_dot_product(p.vector::double[], r.rv) / sqrt(list_dot_product(r.rv, r.rv))) - 0.05) / 0.20','0.0','1.0')}, 0.0) as epic
      from merged m left join points p using (point_id) left join r using (job_id))
    select job_id, candidate_key, {rnd(f"cast({_ew['cosine']!r} as double)*{COS_NORM} + cast({_ew['epic_sim']!r} as double)*epic",4)} as composite_rank, {rnd('epic',6)} as epic_sim from e"""

# weights of the ten cases, spelled out: profile by label % 3, signals by label % 4, reference vector for even labels
_cases = {}
for _label in range(10):
    _profile = list(PROFILES)[_label % 3]
    if _label == 7:
        _cases[_label] = {"cosine": 0.75, "mystery": 0.25}
    elif _label % 4 == 0:
        _cases[_label] = _weights(_profile, ["cosine", "nima", "epic_sim"])
    elif _label % 4 == 1:
        _cases[_label] = _weights(_profile, ["cosine", "sharpness", "contrast"])
    else:
        _cases[_label] = _weights(_profile, ["cosine", "nima", "technical"])
_values = ", ".join(f"({label}, '{s}', cast({w!r} as double))" for label, ws in _cases.items() for s, w in ws.items())
ORACLE_BODIES["resolve_weights"] = f"""select l.label, w.signal, {rnd('w.weight',8)} as weight from (select distinct label from embeddings) l
    join (values {_values}) w(label, signal, weight) on w.label = l.label"""

_pairs = f"""with p as (select vec_id, embedding as v, list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * 0.3 + cast(embedding[i % 64 + 1] as double)) as q from embeddings),
    s as (select a.vec_id as i, b.vec_id as j, {rnd(cosine('a.v','b.q'),8)} as s from p a, p b),
    t as (select i, s as true_s from s where i = j),
    r as (select t.i as pair_id, t.true_s as true_similarity, 1 + count(*) filter (s.j <> s.i and (s.s > t.true_s or (s.s = t.true_s and s.j < s.i))) as true_rank,
      {rnd('t.true_s - coalesce(max(case when s.j <> s.i then s.s end), 0.0)',8)} as margin from t join s on s.i = t.i group by t.i, t.true_s)"""
ORACLE_BODIES["retrieval_ranks"] = _pairs + " select pair_id, true_similarity, true_rank, margin from r"
ORACLE_BODIES["retrieval_eval"] = _pairs + f""" select count(*) as pairs, {rnd('avg(case when true_rank = 1 then 1.0 else 0.0 end)',6)} as top1_accuracy,
    {rnd('avg(case when true_rank <= 3 then 1.0 else 0.0 end)',6)} as top3_accuracy, {rnd(mean('margin'),6)} as mean_margin from r"""
_drift = f"""with c as (select vec_id, embedding::double[] as a, list_transform(embedding, lambda x: floor(cast(x as double)*100+0.5)/100) as b from embeddings),
    d as (select vec_id, list_cosine_similarity(a, b) as cosine, list_avg(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2))) as mse from c)"""
ORACLE_BODIES["embedding_drift"] = _drift + f" select vec_id, {rnd('cosine',8)} as cosine, {rnd('mse',10)} as mse, {rnd('cosine*100',6)} as retention_pct from d"
ORACLE_BODIES["drift_summary"] = _drift + f" select count(*) as vectors, {rnd(mean('cosine',12,12),8)} as mean_cosine, {rnd('min(cosine)',8)} as min_cosine, {rnd(mean('mse',12,12),10)} as mean_mse from d"


def _generated(profiles: list[str], columns: str) -> str:
    """Ranked candidates of each profile fill the target from nothing; with these targets no trim applies."""
    rows = []
    for name in profiles:
        w = _weights(name, ["cosine", "nima", "technical"])
        value = " + ".join(f"cast({w[s]!r} as double)*{v}" for s, v in (("cosine", COS_NORM), ("nima", NIMA), ("technical", TECH)))
        rows.append(f"select *, '{name}' as profile, {rnd(value,4)} as composite_rank from merged")
    key = "job_id, profile"
    return f"""with a as ({' union all '.join(rows)}),
        b as (select *, max(score >= 0.08) over (partition by {key}) as p, row_number() over (partition by {key} order by {RANK_VALUE} desc, seq) as n from a),
        c as (select *, row_number() over (partition by {key}, file_path order by {RANK_VALUE} desc, seq) as per_file from b where score >= 0.08 or (not p and n <= 10)),
        d as (select *, case when file_type='video' then 4000 else 2500 end as len, row_number() over (partition by {key} order by {RANK_VALUE} desc, seq) as k from c where per_file = 1),
        e as (select d.*, target_duration, coalesce(sum(len) over (partition by {key} order by k rows between unbounded preceding and 1 preceding), 0) as before_ms from d join jobs using (job_id)),
        f as (select *, row_number() over (partition by {key} order by coalesce(creation_timestamp,0), k) - 1 as position from e where before_ms < target_duration * 1000)
        select {columns} position, job_id, file_path, len / 1000.0::double as duration, source_offset as start_offset,
          case when file_type='video' then source_offset + len / 1000.0::double else 0.0 end as end_offset, case when file_type='video' then 'video_clip' else 'image' end as segment_type from f"""


ORACLE_BODIES["alternatives"] = _generated(list(PROFILES), "profile,")
ORACLE_BODIES["generate_timelines"] = _generated(["journey"], "")
ORACLE_BODIES["hash_embed_text"] = "select doc_id, cast(64 as integer) as dimension, 1.0::double as norm from documents"
ORACLE_BODIES["embed_table"] = f"""with w as (select doc_id, unnest(string_split(coalesce(text, ''), ' ')) as word from documents),
    b as (select doc_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 64 as slot, count(*) as n from w where word <> '' group by 1, 2),
    l as (select doc_id, sqrt(cast(sum(n * n) as double)) as length from b group by 1),
    s as (select doc_id, sum(cast(cast(n / length as float) as double) * slot) as by_slot, sum(case when slot % 2 = 0 then cast(cast(n / length as float) as double) else 0 end) as even
      from b join l using (doc_id) group by 1)
    select doc_id, true as embedded, {rnd('coalesce(by_slot, 0.0)',3)} as by_slot, {rnd('coalesce(even, 0.0)',3)} as even_slots from documents left join s using (doc_id)"""
ORACLE_BODIES["detect_scenes"] = f"""with recursive c as (select file_id, idx, src_fps, abs(value - lag(value) over (partition by file_id order by idx)) as change from frame_index),
    l as (select a.file_id, a.idx, any_value(a.change) as change, avg(b.change) as local from c a join c b on b.file_id = a.file_id and b.idx between a.idx - 2 and a.idx + 2 and b.idx <> a.idx group by 1, 2),
    cand as (select file_id, idx from l where change > 0.1 and change / greatest(local, 1e-9) >= 2.0),
    v as (select file_id, coalesce(max(src_fps), 30.0) as fps, max(idx) + 1 as n, greatest(15, cast(round_even(coalesce(max(src_fps), 30.0) * 2, 0) as bigint)) as gate from frame_index group by 1),
    taken as (select file_id, cast(0 as bigint) as start_frame from v
      union all select t.file_id, min(cand.idx) from taken t join v on v.file_id = t.file_id join cand on cand.file_id = t.file_id and cand.idx >= t.start_frame + v.gate group by t.file_id),
    s as (select file_id, start_frame, row_number() over (partition by file_id order by start_frame) - 1 as scene_id, lead(start_frame) over (partition by file_id order by start_frame) as following from taken)
    select s.file_id, cast(scene_id as integer) as scene_id, {rnd('start_frame / fps',3)} as scene_start, {rnd('coalesce(following, n) / fps',3)} as scene_end, start_frame, coalesce(following, n) as end_frame
    from s join v using (file_id)"""


def _merge_with(text: str) -> str:
    """Statements that bring their own ``with`` list get the building blocks placed before it."""
    body = text.strip()
    if not body.lower().startswith("with "):
        return _sql(body)
    names: list[str] = []
    _needed(body, names)
    if not names:
        return body
    own = body[5:].removeprefix("recursive ")
    word = "with recursive " if own != body[5:] else "with "
    return word + ",\n".join(f"{n} as ({CTES[n]})" for n in names) + ",\n" + own


ORACLE: dict[str, str] = {name: _merge_with(body) for name, body in ORACLE_BODIES.items()}
