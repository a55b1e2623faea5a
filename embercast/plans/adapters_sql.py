"""DuckDB text of the testdata adapters, for the oracle queries.

Each constant is a CTE body; ``with_views(...)`` prefixes the ones a query needs.
The arithmetic is the same as ``embercast.sources.testdata`` (integer sums, then
double multiplications in the same order).
"""

OBS_DAILY = """
obs_daily as (
  select date, site_id,
    15 + ti*cast(0.25 as double) as temperatura,
    20 + hi*cast(0.75 as double) as humedad,
    vi*cast(0.5 as double) as velocidad_viento,
    greatest(pi-60, 0)*cast(0.5 as double) as precipitacion,
    15 + ti*cast(0.25 as double) + 1 + (vi%9)*cast(0.5 as double) as temp_max,
    15 + ti*cast(0.25 as double) - 1 - (pi%7)*cast(0.5 as double) as temp_min,
    case when ti-hi+ni > 50 then 1 else 0 end as incendio
  from (
    select cast(l_shipdate as date) as date, cast(l_suppkey as int) as site_id,
      cast(sum(l_orderkey) % 101 as int) as ti,
      cast(sum(l_partkey) % 101 as int) as hi,
      cast(sum(l_orderkey*7 + l_partkey*5) % 61 as int) - 30 as ni,
      cast(sum(l_partkey*3 + l_linenumber*11) % 101 as int) as vi,
      cast(sum(l_orderkey*3 + l_linenumber*13) % 101 as int) as pi
    from lineitem group by 1, 2) k)"""

OBS_NULLS = """
obs_nulls as (
  select date, site_id,
    case when dayofyear(date) % 11 >= 3 then temperatura end as temperatura,
    case when dayofyear(date) % 13 >= 2 then humedad end as humedad,
    case when dayofyear(date) > 2 then velocidad_viento end as velocidad_viento,
    precipitacion, temp_max, temp_min, incendio
  from obs_daily)"""

OBS_DUPS = """
obs_dups as (
  select *, 1 as ingest_seq from obs_daily
  union all
  select date, site_id, temperatura + 1 as temperatura, humedad, velocidad_viento, precipitacion,
    temp_max, temp_min, incendio,
    case when (site_id + dayofyear(date)) % 2 = 0 then 0 else 2 end as ingest_seq
  from obs_daily)"""

OBS_RAW = """
obs_raw as (
  select date, site_id,
    case when dayofyear(date) % 11 >= 3 then temperatura end as temperatura,
    case when dayofyear(date) % 13 >= 2 then humedad end as humedad,
    case when dayofyear(date) > 2 then velocidad_viento end as velocidad_viento,
    precipitacion, temp_max, temp_min, incendio, ingest_seq
  from obs_dups)"""

HOTSPOTS = """
hotspots as (
  select event_id, cast(ts as date) as acq_date,
    cast(json_extract_string(props, '$.k') as int) as confidence,
    300 + value as brightness, value as frp,
    cast(-17.8 as double) + cast(user_id % 100 as double)/100 + 0.005 as latitude,
    cast(-66.7 as double) + cast(event_id % 120 as double)/100 + 0.005 as longitude
  from events)"""

SITES = """
sites as (
  select cast(n_nationkey as int) as site_id,
    cast(-17.8 as double) + cast(n_nationkey % 5 as double)*0.2 as south,
    cast(-17.8 as double) + cast(n_nationkey % 5 as double)*0.2 + 0.2 as north,
    cast(-66.7 as double) + cast(floor(n_nationkey / 5) as double)*0.24 as west,
    cast(-66.7 as double) + cast(floor(n_nationkey / 5) as double)*0.24 + 0.24 as east
  from nation)"""

SCORED = """
scored as (
  select event_id, cast(event_type = 'error' as int) as y,
    cast(cast(json_extract_string(props, '$.k') as int) as double)/100 as prob,
    cast(cast(cast(json_extract_string(props, '$.k') as int) as double)/100 >= 0.5 as int) as pred
  from events)"""

HOURLY = """
located as (
  select e.event_id, e.ts, e.value, s.site_id
  from (select event_id, ts, value,
          cast(-17.8 as double) + cast(user_id % 100 as double)/100 + 0.005 as latitude,
          cast(-66.7 as double) + cast(event_id % 120 as double)/100 + 0.005 as longitude
        from events) e
  join sites s on e.latitude between s.south and s.north and e.longitude between s.west and s.east),
hourly as (
  select site_id, cast(ts as date) as date, cast(hour(ts) as int) as hour,
    avg(10 + cast(trunc(value) as int) % 25) as temperature_2m,
    avg(30 + event_id % 60) as relative_humidity_2m,
    avg((cast(trunc(value) as int)*7) % 40) as wind_speed_10m
  from located group by 1, 2, 3)"""

_ORDER = ["obs_daily", "obs_nulls", "obs_dups", "obs_raw", "hotspots", "sites", "scored", "hourly"]
_TEXT = {"obs_daily": OBS_DAILY, "obs_nulls": OBS_NULLS, "obs_dups": OBS_DUPS, "obs_raw": OBS_RAW,
         "hotspots": HOTSPOTS,
         "sites": SITES, "scored": SCORED, "hourly": HOURLY}
_NEEDS = {"obs_nulls": ["obs_daily"], "obs_dups": ["obs_daily"], "obs_raw": ["obs_dups"], "hourly": ["sites"]}


def with_views(*names: str, extra: str = "") -> str:
    """``with`` clause holding the named adapters (dependencies included)."""
    want: set[str] = set()

    def add(n):
        for d in _NEEDS.get(n, []):
            add(d)
        want.add(n)

    for n in names:
        add(n)
    parts = [_TEXT[n].strip() for n in _ORDER if n in want]
    if extra:
        parts.append(extra.strip())
    return "with " + ",\n".join(parts) + "\n"
