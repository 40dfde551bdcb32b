"""DuckDB SQL for the registered queries, in other terms than the plans: self-joins for windows, recursion for components."""

from __future__ import annotations

import re

_LAT = "(-67.5 + 15.0 * lat_i)::double"
_LON = "(-168.0 + 24.0 * lon_i)::double"


def _gradient(value: str, source: str, by: str, km: bool) -> str:
    """SQL for the length of the gradient by self-joins on the next and last index of each axis."""
    key = f"{by} = " if by else ""
    on = lambda n, di, dj: f"left join {source} {n} on {f'{n}.{by} = c.{by} and ' if key else ''}{n}.lat_i = c.lat_i {di} and {n}.lon_i = c.lon_i {dj}"
    side = lambda a, b, x: (
        f"case when {a}.{x} is null then ({b}.v - c.v) / ({b}.{x} - c.{x}) when {b}.{x} is null then (c.v - {a}.v) / (c.{x} - {a}.{x}) "
        f"else (pow(c.{x} - {a}.{x}, 2) * {b}.v + (pow({b}.{x} - c.{x}, 2) - pow(c.{x} - {a}.{x}, 2)) * c.v - pow({b}.{x} - c.{x}, 2) * {a}.v) "
        f"/ ((c.{x} - {a}.{x}) * ({b}.{x} - c.{x}) * ({b}.{x} - {a}.{x})) end"
    )
    scale = ("111.32", "(111.32 * greatest(cos(radians(c.lat)), 0.01))") if km else ("1.0", "1.0")
    return (
        f"select c.* exclude (v), c.v as {value}, sqrt(pow({side('s', 'n', 'lat')} / {scale[0]}, 2) + pow({side('w', 'e', 'lon')} / {scale[1]}, 2)) as g from {source} c "
        f"{on('s', '- 1', '')} {on('n', '+ 1', '')} {on('w', '', '- 1')} {on('e', '', '+ 1')}"
    )


_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def _km(a: str, b: str, c: str, d: str) -> str:
    return _HAVERSINE.format(a=a, b=b, c=c, d=d)


def _components(name: str, nodes: str, edges: str) -> dict[str, str]:
    """CTEs that give each node of nodes(x) the smallest it reaches over edges(a, b)."""
    return {
        f"{name}_reach": f"select x, x as y from {nodes} union select r.x, e.b from {name}_reach r join (select a, b from {edges} union select b, a from {edges}) e on e.a = r.y",
        f"{name}": f"select x, min(y) as root from {name}_reach group by x",
    }


_BLOB = "(1 << 40) * t::bigint + (1 << 20) * {i}::bigint + {j}"
CTE: dict[str, str] = {
    "cells": f"select i.range::int lat_i, j.range::int lon_i, {_LAT.replace('lat_i', 'i.range')} lat, {_LON.replace('lon_i', 'j.range')} lon from range(10) i cross join range(15) j",
    "obs": "select ts, (user_id % 150 % 10)::int lat_i, (user_id % 150 // 10)::int lon_i, value / 9.7 as value from events",
    "daily_": "select ts::date as day, lat_i, lon_i, avg(value) v from obs group by all",
    "days": "select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from daily_",
    "cube": "select d.day, (d.day - (select min(day) from daily_))::int as t, c.*, o.v as value from days d cross join cells c left join daily_ o on o.day = d.day and o.lat_i = c.lat_i and o.lon_i = c.lon_i",
    "clim0": "select dayofyear(day) as doy, lat_i, lon_i, avg(value) as clim from cube group by all",
    "pos0": "select doy, row_number() over (order by doy) - 1 as pos, count(*) over () as n from (select distinct doy from clim0)",
    "clim": "select a.doy, c.lat_i, c.lon_i, avg(c.clim) as clim from pos0 a cross join range(-7, 8) k join pos0 b on b.pos = ((a.pos + k.range) % a.n + a.n) % a.n join clim0 c on c.doy = b.doy group by all",
    "anom": "select c.day, c.t, c.lat_i, c.lon_i, c.lat, c.lon, c.value - m.clim as anomaly from cube c join clim m on m.doy = dayofyear(c.day) and m.lat_i = c.lat_i and m.lon_i = c.lon_i",
    "q": "select x.day, x.t, x.lat_i, x.lon_i, x.lat, x.lon, sum(coalesce(y.anomaly, 0) * pow(0.98, x.t - y.t)) as v from anom x join anom y on y.lat_i = x.lat_i and y.lon_i = x.lon_i and y.t between x.t - 6 and x.t group by all",
    "q0": "select x.t, x.lat_i, x.lon_i, sum(coalesce(y.anomaly, 0)) as v from anom x join anom y on y.lat_i = x.lat_i and y.lon_i = x.lon_i and y.t between x.t - 6 and x.t group by all",
    "grad": _gradient("charge", "q", "t", True),
    "heights": "select (s_suppkey % 150 % 10)::int lat_i, (s_suppkey % 150 // 10)::int lon_i, max(greatest(s_acctbal, 0) / 2.3) h from supplier group by all",
    "flat": "select c.*, coalesce(h.h, 0) as v from cells c left join heights h using (lat_i, lon_i)",
    "terrain": _gradient("elevation", "flat", "", False),
    "p99_slope": "select coalesce(nullif(quantile_cont(g, 0.99), 0), 1) p from terrain",
    "ground_eps": "select lat_i, lon_i, 1 - 0.5 * greatest(0, least(1, elevation / 4000)) as eps from terrain",
    "field": "select g.*, e.eps, g.g / greatest(e.eps, 1e-6) as E from grad g join ground_eps e using (lat_i, lon_i)",
    "thr": "select quantile_cont(E, 0.9) as thr from field where abs(lat) <= 66",
    "flag": "select f.* from field f, thr where abs(lat) <= 66 and E > thr.thr",
    "flag_x": "select *, t * 100000 + lat_i * 100 + lon_i as x from flag",
    "adj": "select a.t, a.lat_i a_lat_i, a.lon_i a_lon_i, b.lat_i b_lat_i, b.lon_i b_lon_i, a.x a, b.x b from flag_x a join flag_x b on a.t = b.t and abs(a.lat_i - b.lat_i) <= 3 and abs(a.lon_i - b.lon_i) <= 3 and a.x < b.x",
    **_components("cc", "flag_x", "adj"),
    "labelled": "select f.*, c.root from flag_x f join cc c using (x)",
    "blobs": "select t, day, root, count(*) n_cells, max(E) peak_E, arg_max(lat, (E, -lat_i, -lon_i)) lat, arg_max(lon, (E, -lat_i, -lon_i)) lon, "
    "(root % 100000 // 100) fi, root % 100 fj from labelled group by all having count(*) >= 3",
    "links": f"select a.root a, b.root b, a.t, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} km, a.fi afi, a.fj afj, b.fi bfi, b.fj bfj, b.t bt from blobs a join blobs b on a.t = b.t + 1 where {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2000",
    "blob_x": "select root x from blobs",
    **_components("ev", "blob_x", "links"),
    "events_": "select b.*, e.root as ev, dense_rank() over (order by e.root) as event_id from blobs b join ev e on e.x = b.root",
    "cat0": "select event_id, min(day) date_start, max(day) date_end, (max(t) - min(t) + 1)::int duration_days, arg_min(lat, root) incept_lat, arg_min(lon, root) incept_lon, arg_min(t, root) t0, max(peak_E) peak_E, max(n_cells) max_cells from events_ group by event_id",
    "refs": "select coalesce(nullif((select quantile_cont(g, 0.99) from field), 0), 1) g_ref, coalesce(nullif((select quantile_cont(1 / greatest(eps, 1e-6), 0.99) from ground_eps), 0), 1) inv_ref",
    "cat": "select c.*, f.g / r.g_ref heat, 1 / greatest(f.eps, 1e-6) / r.inv_ref ground, (f.charge - o.charge) / greatest(1, c.t0 - greatest(0, c.t0 - 7)) ramp from cat0 c cross join refs r "
    "join field f on f.t = c.t0 and f.lat = c.incept_lat and f.lon = c.incept_lon join field o on o.t = greatest(0, c.t0 - 7) and o.lat = c.incept_lat and o.lon = c.incept_lon",
    "inc": "select o_orderkey incident_id, (date '2024-01-01' + (o_orderkey // 10 % 30)::int)::date date_start, (-60.0 + o_custkey * 37 % 121)::double lat, (-180.0 + o_orderkey * 53 % 360)::double lon, "
    "case when o_orderkey % 3 = 0 then 'estimated' else 'exact' end geo_precision from orders",
    "near": f"select c.event_id, i.incident_id, {_km('c.incept_lat', 'c.incept_lon', 'i.lat', 'i.lon')} km, (i.date_start - c.date_end)::int as lead_, (c.date_start - i.date_start)::int as late_, c.peak_E from cat0 c cross join inc i",
    "pairs": "select * from near where km <= 1500 and late_ <= 2 and lead_ <= 2",
    "sizes": "select (select count(*) from cat0) n_predicted, (select count(*) from inc) n_incidents, (select greatest(1, max(date_start) - min(date_start)) from inc) total_days",
    "ldays": "select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from long",
    "ldense": "select (d.day - (select min(day) from long))::int as t, i.range::int as lat_i, j.range::int as lon_i, l.value from ldays d cross join range(2) i cross join range(5) j "
        "left join long l on l.day = d.day and l.lat_i = i.range and l.lon_i = j.range",
    "rec": "select c_custkey, printf('%d-%04d', 2000 + c_custkey // 10000, c_custkey % 10000) as key, case when c_custkey % 11 != 0 then make_date(1990 + c_custkey % 30, "
        "least(greatest(case when c_custkey % 7 != 0 then c_custkey % 15 else 1 end, 1), 12), least(greatest(case when c_custkey % 5 != 0 then c_custkey % 33 else 1 end, 1), 28)) end as date_start, "
        "case when c_custkey % 11 != 0 then make_date(1990 + c_custkey % 30, 12, least(greatest(c_custkey % 40, 1), 28)) end as date_end from customer",
    "climate_orders": "select * from (select *, list_extract(['Flood', 'Earthquake', 'Extreme temperature', 'Ash fall', 'Tropical STORM', 'Epidemic', 'Wildfire (forest)', 'Drought'], o_orderkey % 8 + 1) as type from orders) "
        "where type in ('Flood', 'Extreme temperature', 'Tropical STORM', 'Wildfire (forest)', 'Drought')",
    "long": "select l_shipdate::date as day, (l_suppkey % 2)::int lat_i, (l_suppkey // 2 % 5)::int lon_i, avg(l_quantity) as value from lineitem group by all",
    "lclim": "select dayofyear(day) as doy, lat_i, lon_i, avg(value) as clim from long group by all",
    "lpos": "select doy, row_number() over (order by doy) - 1 as pos, count(*) over () as n from (select distinct doy from lclim)",
    "tgt": "select i.range::int lat_i, (-85.0 + 10 * i.range)::double lat, j.range::int lon_i, (-170.0 + 20 * j.range)::double lon from range(18) i cross join range(18) j",
    "corners": "select g.*, floor((g.lat + 67.5) / 15)::int a, floor((g.lon + 168) / 24)::int b from tgt g",
    "inside": "select *, (lat >= -67.5 and lat <= 67.5 and lon >= -168 and lon <= 168) ok, least(a, 8) a0, least(b, 13) b0 from corners",
    "dcore": "select a.x from flag_x a join flag_x b on a.t = b.t and sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 30 + 1e-9 group by a.x having count(*) >= 3",
    "dnear": "select a.x a, b.x b from flag_x a join flag_x b on a.t = b.t and a.x <> b.x and sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 30 + 1e-9",
    "dedge": "select a, b from dnear where a in (select x from dcore) and b in (select x from dcore)",
    **_components("dc", "dcore", "dedge"),
    "dlab": "select x, root from dc union all select n.a, min(d.root) from dnear n join dc d on d.x = n.b where n.a not in (select x from dcore) group by n.a",
    "grid10": "select i.range::int lat_i, (-85.0 + 10 * i.range)::double lat, j.range::int lon_i, (-175.0 + 10 * j.range)::double lon from range(18) i cross join range(36) j",
    "tgrid": "select i.range::int lat_i, (-82.5 + 15 * i.range)::double lat, j.range::int lon_i, (-172.5 + 15 * j.range)::double lon from range(12) i cross join range(24) j",
    "tdays": "select (date '2015-01-01' + t.range::int)::date as day, t.range::int as t from range(90) t",
    "kinds": "select o_orderkey, trim((['" + "', '".join((" Flood", "Earthquake", "Extreme temperature ", "Ash fall", "Tropical STORM", "Epidemic", "Wildfire (forest)", "Drought")) + "'])[o_orderkey % 8 + 1]) as type from orders",
    "parts": "select o_orderkey k, case when k % 11 = 0 then null else 1990 + k % 30 end y, coalesce(case when k % 7 <> 0 then k % 15 end, 1) m, coalesce(case when k % 5 <> 0 then k % 33 end, 1) d from orders",
    "dated": "select '2010-' || lpad((c_custkey % 10000)::varchar, 4, '0') as key, c_custkey, case when c_custkey % 3 <> 0 then make_date(2010, least(greatest(c_custkey % 14, 1), 12), least(greatest(c_custkey % 31, 1), 28)) end as date_start from customer",
    "settings": "select (i - 1) * 3 + j - 1 as k, ([500.0, 1000.0, 1500.0])[i]::double radius_km, ([0.0, 2.0, 5.0])[j]::double lookback from range(1, 4) a(i) cross join range(1, 4) b(j)",
    "swept": "select s.k, s.radius_km, s.lookback, (select count(distinct incident_id) from near where km <= s.radius_km and lead_ <= s.lookback and late_ <= 2)::bigint incidents_hit, "
    "(select count(distinct event_id) from near where km <= s.radius_km and lead_ <= s.lookback and late_ <= 2)::bigint predictions_that_hit from settings s",
    "glat": f"select *, {' + '.join(f'{top} * exp(-(pow(lat - {lat}, 2) + pow(lon - {lon}, 2)) / {2 * width**2})' for lat, lon, top, width in ((35.0, 80.0, 5000.0, 12.0), (45.0, -110.0, 3500.0, 14.0), (-20.0, -65.0, 4500.0, 10.0)))} as v from grid10",
    "gterr": _gradient("elevation", "glat", "", False),
    "tail": "select s.*, i, least(1 - pow(1 - pi() * 1500.0 * 1500.0 / (4 * pi() * 6371.0 * 6371.0) * least(1, 4.0 / total_days), n_predicted), 0.999999) p from (select *, (select count(distinct incident_id) from pairs) i from sizes) s",
    "pvalue": "select i, n_incidents n, case when i <= 0 then 1.0 else (select least(1.0, sum(exp(lgamma(n_incidents + 1) - lgamma(k + 1) - lgamma(n_incidents - k + 1) + k * ln(p) + (n_incidents - k) * ln(1 - p)))) "
    "from range(0, n_incidents + 1) t(k) where k >= i) end as p_value, p from tail",
    "ranked": "select event_id, peak_E, (select count(*) from cat0 b where b.peak_E > a.peak_E or (b.peak_E = a.peak_E and b.event_id <= a.event_id)) as rank from cat0 a",
}
_AT = "t, lat_i, lon_i"
_BLOB_KEY = "{t} || '-' || {i} || '-' || {j}"
SQL: dict[str, str] = {
    "chunk_scan": f"select day, {_AT}, lat, lon, round(value, 5) as value from cube",
    "chunk_slice": f"select day, {_AT}, round(value, 5) as value from cube where lat between -45 and 45 and lon between -100 and 100 and day between '2024-01-05' and '2024-01-12'",
    "incidents_located": "select printf('%d-%04d', 2000 + o_custkey // 10000, o_custkey % 10000) || '_' || o_orderkey as incident_id, type, 'C\u00f4te' as country, date_start, date_end, "
        "(-60.0 + o_custkey * 37 % 121)::double as lat, (-180.0 + o_orderkey * 53 % 360)::double as lon, 'exact' as geo_precision from climate_orders join rec on rec.c_custkey = o_custkey "
        "where o_orderkey % 9 != 0 and date_start is not null and -60 + o_custkey * 37 % 121 between -50 and 50 and -180 + o_orderkey * 53 % 360 between -120 and 120",
    "incidents_recorded": "select key || '-' || c_mktsegment as incident_id, type, c_mktsegment as subtype, 'land' as country, 'N' || c_nationkey as iso, lat, lon, date_start, date_end, geo_precision "
        "from (select c.c_mktsegment, c.c_nationkey, rec.*, list_extract(['Flood', 'Earthquake', 'Extreme temperature', 'Ash fall', 'Tropical STORM', 'Epidemic', 'Wildfire (forest)', 'Drought'], c.c_custkey % 8 + 1) as type, "
        "case when c.c_custkey % 3 != 0 and c.c_custkey % 4 != 0 then (c.c_custkey % 90)::double when c.c_nationkey != 7 then -48.0 + 4.0 * c.c_nationkey end as lat, "
        "case when c.c_custkey % 3 != 0 and c.c_custkey % 4 != 0 then (c.c_custkey % 180)::double when c.c_nationkey != 7 then -150.0 + 12.0 * c.c_nationkey end as lon, "
        "case when c.c_custkey % 3 != 0 and c.c_custkey % 4 != 0 then 'exact' else 'estimated' end as geo_precision from customer c join rec on rec.c_custkey = c.c_custkey) "
        "where type in ('Flood', 'Extreme temperature', 'Tropical STORM', 'Wildfire (forest)', 'Drought') and date_start is not null and lat between -50 and 50 and lon between -120 and 120",
    "scan_cube": f"select day, {_AT}, lat, lon, round(value, 5) as value from cube",
    "normalize_lon": "select o_orderkey, case when k > 180 or m > 180 then (k + 180) % 360 - 180 else k end as lon from (select o_orderkey, (o_orderkey * 53 % 360)::double k, max(o_orderkey * 53 % 360) over () m from orders)",
    "domain_slice": f"select day, {_AT}, round(value, 5) as value from cube where lat between -45 and 45 and lon between -100 and 100 and day between '2024-01-05' and '2024-01-12'",
    **{f"daily_{n}": f"select ts::date as day, lat_i, lon_i, round({f}(value), 5) as value from obs group by all" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))},
    "regrid_bilinear": "select i.lat_i, i.lon_i, i.lat, i.lon, case when any_value(ok) then round(sum(f.v * (1 - abs(i.lat - f.lat) / 15) * (1 - abs(i.lon - f.lon) / 24)), 5) end as elevation "
    "from inside i left join flat f on i.ok and f.lat_i in (a0, a0 + 1) and f.lon_i in (b0, b0 + 1) group by all",
    "terrain_fields": "select lat_i, lon_i, lat, lon, round(elevation, 5) as elevation, round(g, 7) as slope from terrain",
    "gen_grid": "select * from grid10",
    "gen_temperature_det": "select d.day, d.t, g.lat_i, g.lon_i, round(288 - 0.45 * abs(lat) + (2 + 0.25 * abs(lat)) * sin(2 * pi() * (dayofyear(d.day) - 80) / 365.25) * sign(lat) "
    "+ 14 * greatest(0, 1 - abs(d.t - 30) / 25.0) * exp(-(pow(lat - 33, 2) + pow(lon - 78, 2)) / 72), 6) as value from tdays d cross join tgrid g",
    "elevation": "select s_suppkey, round(s_acctbal / 9.80665, 6) as elevation from supplier",
    "anomaly": f"select {_AT}, round(anomaly, 5) as anomaly from anom",
    "permittivity_linear": "select lat_i, lon_i, round(eps, 7) as eps from ground_eps",
    "permittivity_log": "select lat_i, lon_i, round(1 - 0.5 * least(1, ln(1 + elevation) / ln(4001.0)), 7) as eps from terrain",
    "permittivity_slope": "select lat_i, lon_i, round(1 - 0.5 * greatest(0, least(1, g / p)), 7) as eps from terrain, p99_slope",
    "permittivity_combined": "select lat_i, lon_i, round(1 - 0.5 * greatest(0, least(1, 0.5 * ln(1 + elevation) / ln(4001.0) + 0.5 * g / p)), 7) as eps from terrain, p99_slope",
    "breakdown_field": f"select {_AT}, round(E, 8) as e from field",
    "disno_key": "select o_orderkey, case when length(n) = 9 then n end as key from (select o_orderkey, (o_orderkey % 9000 + 900)::varchar || '-' || lpad((o_orderkey % 10000)::varchar, 4, '0') n from orders)",
    "concat_id": "select l_orderkey, l_linenumber, l_orderkey || '_' || l_linenumber as id from lineitem",
    "assemble_date": "select k as o_orderkey, case when y is not null then make_date(y, least(greatest(m, 1), 12), least(greatest(d, 1), 28)) end as date_start from parts",
    "geo_precision": "select o_orderkey, case when o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0 then 'exact' else 'estimated' end as geo_precision from orders",
    "haversine": f"select incident_id, round({_km('10.0', '20.0', 'lat', 'lon')}, 5) as km from inc",
    "flag_zones_percentile": f"select {_AT}, round(E, 8) as e from flag",
    "flag_zones_absolute": f"select {_AT}, round(E, 8) as e from field where abs(lat) <= 66 and E > 0.00512345",
    "type_filter": "select * from kinds where " + " or ".join(f"contains(lower(type), '{k}')" for k in ("extreme temperature", "heat wave", "heatwave", "cold wave", "storm", "flood", "drought", "wildfire")),
    "domain_box": "select incident_id, lat, lon from inc where lat between -30 and 30 and lon between -100 and 100",
    "day_snapshot": f"select {_AT}, round(v, 5) as charge from q where day = '2024-01-15'",
    "gdis_join": "select o_orderkey, key, date_start from (select o_orderkey, '2010-' || lpad((o_custkey % 10000)::varchar, 4, '0') as key from orders) join (select key, arg_min_null(date_start, c_custkey) date_start from dated group by key) using (key) where date_start is not null",
    "centroid_fallback": "select c_custkey, 'N' || c_nationkey as iso, case when e then (c_custkey % 90)::double else -48.0 + 4 * n_nationkey end as lat, case when e then (c_custkey % 180)::double else -150.0 + 12 * n_nationkey end as lon, "
    "case when e then 'exact' else 'estimated' end as geo_precision from (select *, c_custkey % 3 <> 0 and c_custkey % 4 <> 0 e from customer) left join (select * from nation where n_nationkey <> 7) on n_nationkey = c_nationkey",
    "link_pairs": f"select {_BLOB_KEY.format(t='t', i='afi', j='afj')} as a, {_BLOB_KEY.format(t='bt', i='bfi', j='bfj')} as b, round(km, 4) as km from links",
    "adjacency_pairs": "select t, a_lat_i, a_lon_i, b_lat_i, b_lon_i from adj",
    "coverage_pairs": "select event_id, incident_id, round(km, 4) as km, lead_ as lead, late_ as late from pairs",
    "disasters_hit": "select * from inc where incident_id in (select incident_id from pairs)",
    "disasters_missed": "select * from inc where incident_id not in (select incident_id from pairs)",
    "predictions_hit": "select event_id, date_start, date_end, round(peak_E, 7) as peak_e from cat0 where event_id in (select event_id from pairs)",
    "doy_climatology": "select doy::int as doy, lat_i, lon_i, round(clim, 5) as clim from lclim",
    "climatology_smooth": "select a.doy::int as doy, c.lat_i, c.lon_i, round(avg(v.clim), 5) as clim from lpos a cross join range(-7, 8) k join lpos b on b.pos = ((a.pos + k.range) % a.n + a.n) % a.n cross join (select distinct lat_i, lon_i from lclim) c "
    "left join lclim v on v.doy = b.doy and v.lat_i = c.lat_i and v.lon_i = c.lon_i group by all",
    "threshold_percentile": "select round(thr, 8) as thr from thr",
    "trigger_refs": "select round(g_ref, 8) as g_ref, round(inv_ref, 7) as inv_ref from refs",
    "plot_range": "select round(quantile_cont(abs(anomaly), 0.99), 5) as vabs, round(quantile_cont(anomaly, 0.01), 5) as vmin, round(quantile_cont(anomaly, 0.99), 5) as vmax from anom",
    "daily_blobs": "select t as day_index, day, lat, lon, n_cells, round(peak_E, 8) as peak_e from blobs",
    "dbscan_blobs": "select t as day_index, day, arg_max(lat, (E, -lat_i, -lon_i)) as lat, arg_max(lon, (E, -lat_i, -lon_i)) as lon, count(*) as n_cells, round(max(E), 8) as peak_e from flag_x join dlab using (x) group by t, day, root",
    "link_events": "select event_id, t as day_index, lat, lon, n_cells from events_",
    "event_catalog": "select event_id, date_start, date_end, duration_days, incept_lat, incept_lon, round(peak_E, 8) as peak_e, max_cells, case when heat >= ground then 'heat-driven' else 'terrain-driven' end as trigger, "
    "round_even(heat, 3) as heat_score, round_even(ground, 3) as terrain_score, round_even(ramp, 4) as precursor_ramp from cat",
    "trigger_scores": "select event_id, round_even(heat, 3) as heat_score, round_even(ground, 3) as terrain_score from cat",
    "trigger_label": "select event_id, case when heat >= ground then 'heat-driven' else 'terrain-driven' end as trigger from cat",
    "trigger_counts": "select case when heat >= ground then 'heat-driven' else 'terrain-driven' end as trigger, count(*) as n from cat group by 1",
    "precursor_ramp": "select event_id, round_even(ramp, 4) as precursor_ramp from cat",
    "top_events": "select event_id, date_start, date_end, max_cells, round(peak_E, 8) as peak_e from cat0 order by cat0.peak_E desc, event_id limit 10",
    "active_days": "select count(distinct t) as active_days from blobs",
    "field_summary": "select round(min(anomaly), 5) as lo, round(max(anomaly), 5) as hi, round(avg(anomaly), 5) as mean, round(quantile_cont(anomaly, 0.5), 5) as median, count(*) filter (anomaly > 0) as positive, count(anomaly) as n from anom",
    "dedup_first": "select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) r from lineitem) where r = 1",
    "charge_month": "select x.t, x.lat_i, x.lon_i, round(sum(coalesce(y.value, 0) * pow(0.98, x.t - y.t)), 5) as charge from ldense x join ldense y on y.lat_i = x.lat_i and y.lon_i = x.lon_i "
        "and y.t between x.t - 29 and x.t group by all",
    "charge": f"select {_AT}, round(v, 5) as charge from q",
    "charge_nodecay": f"select {_AT}, round(v, 5) as charge from q0",
    "gradient_magnitude": f"select {_AT}, round(g, 9) as gradient from grad",
    "terrain_slope": "select lat_i, lon_i, round(g, 7) as slope from terrain",
    "recall_precision": "select n_predicted, n_incidents, round(i / n_incidents, 7) as recall, round(e / n_predicted, 7) as prec, i as incidents_hit, e as predictions_that_hit from sizes, (select count(distinct incident_id) i, count(distinct event_id) e from pairs)",
    "recall_by_precision": "select geo_precision, count(*) as n, round(avg((incident_id in (select incident_id from pairs))::int), 7) as recall from inc group by 1",
    "null_model": "select total_days::bigint as total_days, n_predicted, round(1 - pow(1 - pi() * 1500.0 * 1500.0 / (4 * pi() * 6371.0 * 6371.0) * least(1, 4.0 / total_days), n_predicted), 9) as null_recall from sizes",
    "pr_curve": "select r.rank::bigint as rank, round((select count(distinct incident_id) from pairs p join ranked s using (event_id) where s.rank <= r.rank) / n_incidents, 7) as recall, "
    "round((select count(distinct event_id) from pairs p join ranked s using (event_id) where s.rank <= r.rank) / r.rank, 7) as prec from ranked r, sizes where r.rank % greatest(1, n_predicted // 100) = 0 or r.rank = n_predicted",
    "radius_lookback_grid": "select radius_km, lookback, incidents_hit, predictions_that_hit, round(incidents_hit / n_incidents, 7) as recall, round(predictions_that_hit / n_predicted, 7) as prec from swept, sizes",
    "best_sweep_cell": "select radius_km, lookback, round(incidents_hit / n_incidents, 7) as recall from swept, sizes order by incidents_hit desc, k limit 1",
    "gen_terrain": "select lat_i, lon_i, lat, lon, round(elevation, 6) as elevation, round(g, 6) as slope from gterr",
    "binom_pvalue": "select i as incidents_hit, n as n_incidents, round(p, 9) as null_recall, round(p_value, 9) as p_value, p_value < 0.05 as significant from pvalue",
    "level_slice": "select l_orderkey, l_partkey, l_quantity from lineitem where l_linenumber = (select min(l_linenumber) from lineitem)",
    "regrid_same": "select lat_i, lon_i, lat, lon, round(v, 5) as elevation from flat",
    "incident_period": "select * from inc where date_start between '2024-01-05' and '2024-01-20'",
    "target_comparison": "select round(i / n, 7) as recall, round(e / n_predicted, 7) as prec, round(p_value, 9) as p_value, i / n > 0.3 as recall_met, e / n_predicted > 0.1 as precision_met, p_value < 0.05 as significant "
    "from pvalue, (select count(distinct event_id) e from pairs), (select count(*) n_predicted from cat0)",
    "predicted_actual": "select 'predicted' as kind, incept_lat as lat, incept_lon as lon from cat0 union all select 'incident, ' || geo_precision, lat, lon from inc",
    "signal_ratio": "select round(p / (m + 1e-9), 5) as ratio, p / (m + 1e-9) > 3 as ok from (select max(E) filter (lat between 7.5 and 37.5 and lon between -24 and 24) p, quantile_cont(E, 0.5) m from field)",
}


def _needed(sql: str, found: dict[str, None], within: tuple[str, ...] = ()) -> dict[str, None]:
    """The CTEs that a query reads, each after those that it reads itself; a recursive one reads itself."""
    for name in CTE:
        if name not in found and name not in within and re.search(rf"(\b(from|join|in)|,)\s*\(?\s*{name}\b(?!\s*\()", sql):
            _needed(CTE[name], found, (*within, name))
            found[name] = None
    return found


def complete(sql: str) -> str:
    """A query with the CTEs that it needs before it."""
    needed = _needed(sql, {})
    return "with recursive " + ", ".join(f"{name} as ({CTE[name]})" for name in needed) + " " + sql if needed else sql


#: The CTEs from the permittivity to a sweep, in order; with another name each, they are those of a recipe.
_CHAIN = ("ground_eps", "field", "thr", "flag", "flag_x", "adj", "cc_reach", "cc", "labelled", "blobs", "links", "blob_x", "ev_reach", "ev", "events_", "cat0", "near", "sizes", "swept")


def _recipes(least: dict[str, float]) -> str:
    """The sweep of each recipe, which differ by the least permittivity."""
    found, parts = dict.fromkeys(n for n in complete("select 1 from swept, sizes").split() if n in CTE and n not in _CHAIN), []
    base = {}
    for name in ("grad", "terrain", "inc", "settings"):
        _needed(CTE[name], base)
        base[name] = None
    ctes = {name: CTE[name] for name in (*base, *(n for n in found if n not in base))}
    for k, (recipe, low) in enumerate(least.items()):
        own = lambda sql: re.sub(rf"\b({'|'.join(_CHAIN)})\b", rf"\1_{k}", sql)  # noqa: B023, E731
        for name in _CHAIN:
            sql = CTE[name].replace("1 - 0.5 * greatest(0, least(1, elevation / 4000))", f"1 - {1 - low} * greatest(0, least(1, elevation / 4000))")
            ctes[f"{name}_{k}"] = own(sql)
        parts.append(own(f"select '{recipe}' as recipe, n_predicted, radius_km, lookback, incidents_hit, predictions_that_hit, "
                         "round(incidents_hit / n_incidents, 7) as recall, round(predictions_that_hit / n_predicted, 7) as prec from swept, sizes"))
    return "with recursive " + ", ".join(f"{name} as ({sql})" for name, sql in ctes.items()) + " " + " union all ".join(parts)


def oracle_sql() -> dict[str, str]:
    found = {name: complete(sql) for name, sql in SQL.items()}
    return found | {"recipe_grid": _recipes({"none": 1.0, "strong": 0.2, "weak": 0.8})}
