"""DuckDB SQL that gives the same rows as the registered queries, written independently of them."""

from __future__ import annotations

_VIEWS = {
    "district": """select n_nationkey::int id, n_name "name", n_regionkey::int region_id, cast(30+(n_nationkey*37)%1000 as decimal(10,2)) area_sq_km,
        case when n_nationkey%7<>3 then 100000+n_nationkey*7919 end population,
        cast(37.3 as double)+cast(n_nationkey%5 as double)*cast(0.12 as double) lon, cast(55.5 as double)+cast(n_nationkey//5 as double)*cast(0.1 as double) lat from nation""",
    "facility": """select c_custkey id, c_name "name", c_mktsegment "type", c_nationkey::int district_id,
        case when c_custkey%11<>0 then cast(abs(c_acctbal) as decimal(12,2)) end capacity_tons,
        case when c_custkey%13<>0 then cast(500+(c_custkey*31)%4000 as decimal(12,2)) end area_sq_m,
        case c_custkey%3 when 0 then '00:00-24:00' when 1 then 'Round the clock' else '09:00-18:00' end operating_hours,
        case when c_custkey%19=0 then null when c_custkey%23=0 then '' else 'Street '||(c_custkey%97) end address,
        case when c_custkey%17<>0 then cast(37.3 as double)+cast((c_custkey*7919)%1000 as double)/cast(1000 as double)*cast(0.6 as double) end lon,
        case when c_custkey%17<>0 then cast(55.5 as double)+cast((c_custkey*104729)%1000 as double)/cast(1000 as double)*cast(0.5 as double) end lat,
        case when c_custkey%10<>9 then (c_custkey%8)::int end source_id from customer""",
    "flow": """select l_orderkey*8+l_linenumber id, cast(l_shipdate as date) period_date, c_nationkey::int district_id,
        case when l_partkey%23<>0 then p_type end category, l_returnflag direction, cast(l_extendedprice as decimal(14,2)) volume_tons,
        cast(l_quantity as bigint) vehicle_count, (30+l_linenumber*5)::int avg_speed_kmh,
        case when l_linenumber<>7 then (l_suppkey%8)::int end source_id
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join part on l_partkey=p_partkey""",
    "road": """select distinct user_id id, 'Road '||user_id "name", case user_id%3 when 0 then 'highway' when 1 then 'arterial' else 'collector' end road_class,
        case when user_id%29<>0 then (user_id%25)::int end district_id, (1+user_id%6)::int lanes, (40+10*(user_id%7))::int speed_limit_kmh,
        cast(1+user_id%40 as decimal(8,2)) length_km,
        case when user_id%13<>5 then 'LINESTRING (37.'||(30+user_id%60)||' 55.'||(50+user_id%40)||', 37.'||(31+user_id%60)||' 55.'||(51+user_id%40)||')' end geom, case when user_id%9<>8 then (user_id%8)::int end source_id from events""",
    "condition": """select *, (60-4*"level")::int speed from (select event_id id, user_id road_id, ts recorded_at, least(10, floor(value/20)::int)::int "level",
        case when event_id%11<>7 then (event_id%8)::int end source_id from events)""",
    "incident": """select event_id id, ts reported_at, case when event_id%4<>0 then ts+to_hours(k) end resolved_at, 'type '||(k%6) incident_type, (1+k%5)::int severity,
        case when event_id%31<>0 then user_id end road_id, k%2=1 affects_cargo,
        case when event_id%37<>0 then cast(37.3 as double)+cast((event_id*7919)%1000 as double)/cast(1000 as double)*cast(0.6 as double) end lon,
        case when event_id%37<>0 then cast(55.5 as double)+cast((event_id*104729)%1000 as double)/cast(1000 as double)*cast(0.5 as double) end lat, case when event_id%5<>4 then (event_id%8)::int end source_id
        from (select *, cast(json_extract_string(props,'$.k') as int) k from events where event_type='error')""",
    "run": """select o_orderkey id, (o_custkey%8)::int source_id, o_orderdate started_at, case o_orderstatus when 'F' then 'success' when 'O' then 'failed' when 'P' then 'partial' end status,
        floor(o_totalprice)::bigint records_loaded, (o_orderkey%13)::bigint records_errors from orders""",
    "route": """select c*100+s id, c origin_id, s destination_id, case (c+s)%3 when 0 then 'inbound' when 1 then 'outbound' else 'transit' end route_type, 50+(c*s*13)%900 distance_km,
        case when (c+s)%9<>4 then 2+(c+s)%12 end duration_h, trucks,
        case when (c*7+s)%11<>3 then [round(37.3+(c%5)*0.12+((s%5)-(c%5))*0.12*i/4,4)::double for i in [0,2,4]] end xs, case when (c*7+s)%11<>3 then [round(55.5+(c//5)*0.1+((s//5)-(c//5))*0.1*i/4,4)::double for i in [0,2,4]] end ys,
        case when (c*s)%7<>6 then ((c+s)%8)::int end source_id from (select c_nationkey::int c, s_nationkey::int s, count(*) trucks
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey group by 1,2)""",
    "subscription": """select n*5+s id, case when (n*5+s)%5<>0 then n end district_id, s min_severity, n%2=1 cargo_only, n%3<>0 is_active
        from (select n_nationkey::int n, unnest(range(1,6))::int s from nation)""",
    "source": """select i::int id, 'source '||i "name", i<>5 is_active from (select distinct o_custkey%8 i from orders)""",
    "category": """select distinct p_type "name", (length(p_type)%10)::int hazard_class from part""",
    "clock": "select max(ts) tick from events",
}


def _mean(total: str, n: str, scale: int) -> str:
    """total / n in steps of 1 / scale, ties to the even step."""
    up, twice = f"(2*{scale}*({total})+({n}))", f"nullif(2*({n}),0)"
    return f"(({up}//{twice}) - case when {up}%{twice}=0 and ({up}//{twice})%2=1 then 1 else 0 end)/{scale}.0::double"


def _with(sql: str, *views: str) -> str:
    return "with " + ", ".join(f"{v} as ({_VIEWS[v]})" for v in views) + " " + sql


_STATE = "case when {0} is null then 'unknown' when {0}>=9 then 'jam' when {0}>=7 then 'heavy' when {0}>=5 then 'moderate' when {0}>=3 then 'light' else 'free' end"
_LATEST = "select * from condition qualify row_number() over (partition by road_id order by recorded_at desc, id desc)=1"
_MEAN2 = _mean("sum({0})", "count({0})", 100)
_KM = "2*6371.0088*asin(sqrt(least(1.0, pow(sin(radians({3}-{1})/2),2)+cos(radians({1}))*cos(radians({3}))*pow(sin(radians({2}-{0})/2),2))))"
_PROFILE = """select d.id district_id, d."name", d.region_id, d.area_sq_km::double area_sq_km, d.population, d.lon, d.lat, coalesce(o.n,0)::bigint objects, coalesce(o.c,0)::double capacity,
    coalesce(r.n,0)::bigint roads, coalesce(r.km,0)::double road_km, coalesce(f.v,0)::double volume, coalesce(f.n,0)::bigint vehicles, c.x congestion, coalesce(i.n,0)::bigint incidents,
    d.population::double/d.area_sq_km::double density
    from district d left join (select district_id, count(*) n, sum(capacity_tons)::double c from facility group by 1) o on d.id=o.district_id
    left join (select district_id, count(*) n, sum(length_km)::double km from road group by 1) r on d.id=r.district_id
    left join (select district_id, sum(volume_tons)::double v, sum(vehicle_count) n from flow group by 1) f on d.id=f.district_id
    left join (select district_id, MEANLEVEL x from condition join road on road_id=road.id group by 1) c on d.id=c.district_id
    left join (select district_id, count(*) n from incident join road on road_id=road.id group by 1) i on d.id=i.district_id"""
_PROFILE_VIEWS = ("district", "facility", "flow", "road", "condition", "incident")
_INDEX = f"""profile as ({_PROFILE}), raw as (select district_id, "name", capacity, volume flow, coalesce(congestion,0) congestion, incidents::double incidents from profile)"""


def _scored(source: str) -> str:
    parts = {c: f"case when max({c}) over ()=min({c}) over () then 0.5 else ({c}-min({c}) over ())/(max({c}) over ()-min({c}) over ()) end" for c in ("capacity", "flow", "congestion", "incidents")}
    norm = ", ".join(f"{e} {c}_norm" for c, e in parts.items())
    score = "round_even(capacity_norm*cast(0.3 as double)*100+flow_norm*cast(0.3 as double)*100+congestion_norm*cast(0.25 as double)*100+incidents_norm*cast(0.15 as double)*100,1)"
    return f"select *, {score} score, " + ", ".join(f"round_even({c}_norm*100,1) {c}_part" for c in parts) + f" from (select *, {norm} from {source})"


def _with_index(sql: str) -> str:
    head = _with("", *_PROFILE_VIEWS).strip()
    return f"{head}, {_INDEX}, scored as ({_scored('raw')}), ranked as (select *, row_number() over (order by score desc, flow desc, district_id)::int as \"rank\" from scored) {sql}"


_SERIES = "select date_trunc('month', period_date)::date as \"month\", sum(volume_tons)::double volume, sum(vehicle_count)::bigint vehicles, MEANFLOW speed from flow {0} group by 1"
_TREND = """s as (select "month", volume, row_number() over (order by "month")-1 x from (SERIES)), fit as (select regr_slope(volume,x) sl, regr_intercept(volume,x) ic, regr_r2(volume,x) r2 from s),
    t as (select s.*, sl, ic, r2, ic+sl*x trend from s, fit), u as (select *, avg(volume-trend) over (partition by extract(month from "month")) season from t)"""


def _with_trend(sql: str, where: str = "") -> str:
    return f"{_with('', 'flow').strip()}, {_TREND.replace('SERIES', _SERIES.format(where))} {sql}"


# means that several statements write out
_MEANS = {
    "MEANLEVEL": _mean('sum("level")', "count(*)", 100), "MEANSPEED": _mean("sum(speed)", "count(*)", 100), "MEANFLOW": _mean("sum(avg_speed_kmh)", "count(*)", 10),
    "MEANOK": _mean("100*count(*) filter (status='success')", "count(*)", 10), "MEANFOUND": _mean("100*found", "total", 10),
}


def _spelled(sql: str) -> str:
    for name, mean in _MEANS.items():
        sql = sql.replace(name, mean)
    return sql


ORACLES: dict[str, str] = {
    "scan_project": _with('select id, "name", "type" from facility', "facility"),
    "point_lookup": _with('select id, "name", "type", district_id from facility where id=42', "facility"),
    "filter_optional": _with("select id, district_id from facility where district_id=7", "facility"),
    "search_or": _with("select id from facility where contains(lower(\"name\"),'round') or contains(lower(coalesce(address,'')),'round') or contains(lower(operating_hours),'round')", "facility"),
    "search_wildcards": _with("select id from facility where contains(lower(\"name\"),'t_1%') or contains(lower(coalesce(address,'')),'t_1%')", "facility"),
    "search_parts": "select p_partkey from part where contains(lower(p_name),'red') or contains(lower(p_type),'red') or contains(lower(p_brand),'red')",
    "filter_threshold": _with("select id, severity from incident where severity>=4", "incident"),
    "filter_range": _with("select id, period_date, volume_tons::double volume from flow where period_date between date '1996-02-01' and date '1996-03-15'", "flow"),
    "filter_asof": _with("select id, severity from incident, clock where reported_at>=tick-interval 5 day", "incident", "clock"),
    "filter_null": _with("select id from incident where resolved_at is null", "incident"),
    "filter_flags": _with("select id, severity from incident where affects_cargo and resolved_at is not null", "incident"),
    "filter_located": _with("select id from facility where lon is not null", "facility"),
    "filter_whole_day": _with("select id, operating_hours from facility where operating_hours ilike '%round the clock%' or operating_hours='00:00-24:00'", "facility"),
    "filter_empty_address": _with("select id from facility where address is null or address=''", "facility"),
    "fk_path_filter": _with('select i.id, road_id, r."name" from incident i join road r on road_id=r.id where r.district_id=7', "incident", "road"),
    "filter_keys": _with('select id, road_id, "level" from condition where road_id in (select id from road where lanes=6)', "condition", "road"),
    "sort_whitelist": _with('select id, "name", capacity_tons::double capacity from facility order by capacity_tons desc nulls last, "name", id limit 100', "facility"),
    "page_window": _with('select id, "name" from facility order by "name", id limit 25 offset 50', "facility"),
    "page_envelope": _with("select n \"count\", greatest(1,(n+24)//25)::bigint pages, 2::bigint page, case when greatest(1,(n+24)//25)>2 then 3::bigint end as \"next\", 1::bigint previous from (select count(*) n from facility where district_id=7)", "facility"),
    "top_objects": _with("select id, capacity_tons::double capacity from facility order by capacity_tons desc nulls last, id limit 8", "facility"),
    "recent_incidents": _with("select id, severity, incident_type from incident order by reported_at desc, id desc limit 8", "incident"),
    "same_district_objects": _with("select a.id, b.id other_id, row_number() over (partition by a.id order by coalesce(b.capacity_tons,-1) desc, b.id)::int as \"rank\" from facility a join facility b on a.district_id=b.district_id and a.id<>b.id qualify \"rank\"<=6", "facility"),
    "derived_ratios": _with("select id, nullif(capacity_tons,0)::double/nullif(area_sq_m,0)::double utilization from facility", "facility"),
    "route_ratios": _with("select id, distance_km::double/nullif(duration_h,0)::double speed, trucks::double*distance_km::double truck_km from route", "route"),
    "flow_loads": _with("select id, nullif(volume_tons,0)::double/nullif(vehicle_count,0)::double \"load\" from flow", "flow"),
    "congestion_states": _with(f"select {_STATE.format('\"level\"')} state, case when \"level\">=9 then 'crit' when \"level\">=7 then 'alert' when \"level\">=5 then 'warn' else 'ok' end tone, count(*) n, min(\"level\") low, max(\"level\") high from condition group by 1,2", "condition"),
    "severity_states": _with("select ['minor','moderate','serious','severe','critical'][severity] \"label\", case when severity>=5 then 'crit' when severity>=4 then 'alert' when severity>=2 then 'warn' else 'ok' end tone, count(*) n from incident group by 1,2", "incident"),
    "speed_ratios": _with("select c.id, speed::double/nullif(speed_limit_kmh,0)::double ratio from condition c join road r on road_id=r.id", "condition", "road"),
    "durations": _with("select id, resolved_at is null is_open, (epoch_us(coalesce(resolved_at,tick))-epoch_us(reported_at))::double/3.6e9::double \"hours\" from incident, clock", "incident", "clock"),
    "error_rates": _with("select id, coalesce(records_errors::double/nullif(records_loaded+records_errors,0)::double*100,0) error_percent from run", "run"),
    "month_labels": _with(f"select strftime(\"month\",'%m.%y') \"label\", volume from ({_SERIES.format('')})", "flow"),
    "fk_labels": _with('select f.id, d."name" district, s."name" "source" from facility f join district d on f.district_id=d.id left join source s on f.source_id=s.id', "facility", "district", "source"),
    "roads_latest": _with(f'select r.id road_id, r."name", l."level", {_STATE.format('l."level"')} state from road r left join ({_LATEST}) l on l.road_id=r.id', "road", "condition"),
    "category_shares": _with("select category, sum(volume_tons)::double volume, count(*) flows, count(*)::double/sum(count(*)) over () flow_share from flow where category is not null group by 1", "flow"),
    "bbox_filter": _with("select id, lon, lat from facility where lon between 37.4::double and 37.7::double and lat between 55.6::double and 55.8::double", "facility"),
    "nearest_radius": _with(f"select id, round(km,2) distance_km from (select id, {_KM.format('37.6173', '55.7558', 'lon', 'lat')} km from facility) where km<=8 order by km, id limit 20", "facility"),
    "district_distances": _with(f"select a.id a, b.id b, round({_KM.format('a.lon', 'a.lat', 'b.lon', 'b.lat')},2) km from district a join district b on a.region_id=b.region_id and a.id<b.id", "district"),
    "extent": _with("select min(lon) min_lon, min(lat) min_lat, max(lon) max_lon, max(lat) max_lat from facility", "facility"),
    "minmax": _with("select id, (capacity_tons::double-min(capacity_tons) over ()::double)/(max(capacity_tons) over ()::double-min(capacity_tons) over ()::double) capacity_tons_norm from facility", "facility"),
    "zscore": _with("select id, round((capacity_tons::double-avg(capacity_tons::double) over ())/stddev_pop(capacity_tons::double) over (),6) z from facility", "facility"),
    "export_objects": _with("select f.id, f.\"name\", f.\"type\", d.\"name\" district, capacity_tons::double capacity, nullif(capacity_tons,0)::double/nullif(area_sq_m,0)::double utilization from facility f left join district d on f.district_id=d.id where \"type\"='MACHINERY' and (contains(lower(f.\"name\"),'street 1') or contains(lower(coalesce(address,'')),'street 1'))", "facility", "district"),
    "export_summary": _with("select count(*) objects, coalesce(sum(capacity_tons),0)::double capacity, count(*) filter (operating_hours in ('00:00-24:00','Round the clock')) whole_day from facility", "facility"),
    "dashboard_summary": _with("select * from (select count(*) facilities, sum(capacity_tons)::double capacity_tons, count(lon) located from facility), (select count(*) roads, sum(length_km)::double road_km from road), (select sum(volume_tons)::double volume_tons, sum(vehicle_count)::bigint vehicles, min(period_date) first_day, max(period_date) last_day from flow), (select count(*) incidents, count(*) filter (resolved_at is null) open_incidents, count(*) filter (affects_cargo) cargo_incidents from incident), (select count(*) runs, sum(records_loaded)::bigint records from run)", "facility", "road", "flow", "incident", "run"),
    "district_profile": _with(_PROFILE, *_PROFILE_VIEWS),
    "latest_per_road": _with(f'select *, {_STATE.format('"level"')} state from ({_LATEST})', "condition"),
    "current_congestion": _with(f"select {_MEAN2.format('\"level\"')} congestion from ({_LATEST})", "condition"),
    "state_distribution": _with(f"select {_STATE.format('\"level\"')} state, count(*) roads from ({_LATEST}) group by 1", "condition"),
    "flow_timeseries": _with(_SERIES.format(""), "flow"),
    "flow_timeseries_filtered": _with(_SERIES.format("where district_id=7 and direction='R'"), "flow"),
    "flow_by_category": _with("select category, v::double volume, n::bigint vehicles from (select category, sum(volume_tons) v, sum(vehicle_count) n from flow where category is not null group by 1) order by v desc, category limit 10", "flow"),
    "flow_by_direction": _with("select direction, sum(volume_tons)::double volume, count(*) flows, case direction when 'A' then 'arrival' when 'N' then 'transfer' else 'return' end \"label\" from flow group by 1", "flow"),
    "objects_by_type": _with('select "type", count(*) objects, coalesce(sum(capacity_tons),0)::double capacity from facility group by 1', "facility"),
    "incident_stats": _with(", w as (select incident.* from incident, clock where reported_at>=tick-interval 30 day) select 'all' kind, 'all' \"value\", count(*) total, count(*) filter (resolved_at is null) \"open\", count(*) filter (affects_cargo) cargo from w union all select 'type', incident_type, count(*), count(*) filter (resolved_at is null), count(*) filter (affects_cargo) from w group by 2 union all select 'severity', severity::varchar, count(*), count(*) filter (resolved_at is null), count(*) filter (affects_cargo) from w group by 2", "incident", "clock").replace(") ,", "),"),
    "incidents_by_district": _with("select district_id, count(*) incidents from incident join road on road_id=road.id where district_id is not null group by 1", "incident", "road"),
    "daily_profile_dense": _with(f"select h::int \"hour\", x \"level\", coalesce(n,0)::bigint samples from range(24) t(h) left join (select extract(hour from recorded_at+interval 3 hour) hh, {_MEAN2.format('\"level\"')} x, count(*) n from condition, clock where recorded_at>=tick-interval 14 day group by 1) on h=hh", "condition", "clock"),
    "peak_hour": _with(f"select h::int \"hour\", x \"level\" from (select extract(hour from recorded_at+interval 3 hour) h, {_MEAN2.format('\"level\"')} x from condition, clock where recorded_at>=tick-interval 14 day group by 1) order by x desc, h limit 1", "condition", "clock"),
    "etl_health": _with("select count(*) runs, count(*) filter (status='failed') failed, sum(records_loaded)::bigint loaded, sum(records_errors)::bigint errors, MEANOK success_percent from run", "run"),
    "source_usage": _with("select s.id source_id, s.\"name\", s.is_active, coalesce(r.n,0)::bigint runs, coalesce(r.l,0)::bigint loaded, coalesce(r.e,0)::bigint errors, r.t last_run, coalesce(r.e::double/nullif(r.l+r.e,0)::double*100,0) error_percent, (select count(*) from facility where source_id=s.id) facilities, (select count(*) from road where source_id=s.id) roads, (select count(*) from route where source_id=s.id) routes, (select count(*) from flow where source_id=s.id) flows, (select count(*) from condition where source_id=s.id) conditions, (select count(*) from incident where source_id=s.id) incidents from source s left join (select source_id, count(*) n, sum(records_loaded) l, sum(records_errors) e, max(started_at) t from run group by 1) r on s.id=r.source_id", "source", "run", "facility", "road", "route", "flow", "condition", "incident"),
    "coverage": _with("select count(*) total, count(lon) located, 'facility' \"table\" from facility union all select count(*), count(geom), 'road' from road union all select count(*), count(o.lon), 'route' from route left join district o on origin_id=o.id union all select count(*), count(lon), 'incident' from incident union all select count(*), null, 'flow' from flow union all select count(*), null, 'condition' from condition", "facility", "road", "route", "district", "incident", "flow", "condition"),
    "road_stats": _with("select r.id road_id, MEANLEVEL \"level\", MEANSPEED speed, max(\"level\") max_level, count(*) n, any_value(lanes::double*speed_limit_kmh::double) capacity_index from condition c join road r on road_id=r.id group by 1", "condition", "road"),
    "weekly_stats": _with('select count(*) n, sum("level")::double/count(*) "level", sum(speed)::double/count(*) speed from condition, clock where recorded_at>=tick-interval 7 day', "condition", "clock"),
    "routes_by_type": _with("select route_type, count(*) routes, sum(trucks)::bigint trucks, sum(distance_km)::bigint distance, sum(trucks)::double/sum(sum(trucks)) over ()::double \"share\" from route group by 1", "route"),
    "related_counts_zero": _with("select d.id, d.\"name\", count(f.id) facilities, count(*) filter (f.operating_hours in ('00:00-24:00','Round the clock')) whole_day from district d left join facility f on f.district_id=d.id group by 1,2", "district", "facility"),
    "interval_window": _with("select i.id incident_id, c.id condition_id, recorded_at, \"level\", row_number() over (partition by i.id order by recorded_at, c.id)::int as \"rank\" from incident i, clock, condition c where c.road_id=i.road_id and recorded_at between reported_at-interval 6 hour and coalesce(resolved_at,tick)+interval 6 hour qualify \"rank\"<=120", "incident", "clock", "condition"),
    "self_similar_topk": _with("select a.id, b.id other_id, b.trucks other_trucks, row_number() over (partition by a.id order by b.trucks desc, b.id)::int as \"rank\" from route a join route b on a.route_type=b.route_type and a.id<>b.id qualify \"rank\"<=6", "route"),
    "subscription_match": _with("select s.id, count(i.id) matches from subscription s left join (select incident.*, road.district_id d from incident left join road on road_id=road.id) i on severity>=min_severity and (not cargo_only or affects_cargo) and (s.district_id is null or s.district_id=d) where is_active group by 1", "subscription", "incident", "road"),
    "left_semi_keys": _with('select id, "name", road_class from road where id in (select road_id from incident)', "road", "incident"),
    "left_anti_orphans": _with('select id, "name", road_class from road where id not in (select road_id from incident where road_id is not null)', "road", "incident"),
    "growth": _with(f"select f \"first\", l \"last\", (l/f-1)*100 growth, n::bigint vehicles, v/n::double \"load\" from (select arg_min(volume,\"month\") f, arg_max(volume,\"month\") l, sum(vehicles) n, sum(volume::decimal(30,2))::double v from ({_SERIES.format('')}))", "flow"),
    "quality_checks": _with("select \"rule\", found, total, coalesce(MEANFOUND,0) \"share\" from (select 'facility without place' \"rule\", count(*) filter (lon is null) found, count(*) total from facility union all select 'facility without capacity', count(*) filter (capacity_tons is null), count(*) from facility union all select 'facility without address', count(*) filter (coalesce(address,'')=''), count(*) from facility union all select 'facility without source', count(*) filter (source_id is null), count(*) from facility union all select 'road without geometry', count(*) filter (geom is null), count(*) from road union all select 'incident without road', count(*) filter (road_id is null), count(*) from incident union all select 'open incident over 30 days', count(*) filter (reported_at<tick-interval 30 day), count(*) from incident, clock where resolved_at is null)", "facility", "road", "incident", "clock"),
    "constraint_checks": _with("select 'level 0 to 10' \"rule\", count(*) filter (not \"level\" between 0 and 10) found from condition union all select 'severity 1 to 5', count(*) filter (not severity between 1 and 5) from incident union all select 'known direction', count(*) filter (direction not in ('A','N','R')) from flow union all select 'end after start', count(*) filter (resolved_at<reported_at) from incident union all select 'two different ends', count(*) filter (origin_id=destination_id) from route", "condition", "incident", "flow", "route"),
    "load_index": _with_index('select "rank", district_id, "name", score, capacity_part, flow_part, congestion_part, incidents_part, capacity, flow, congestion, incidents from ranked'),
    "index_summary": _with_index('select count(*) districts, round(avg(score),1) mean, round(max(score)-min(score),1) spread, round(stddev_pop(score)/avg(score)*100,1) variation, arg_min("name","rank") leader, arg_max("name","rank") "last" from ranked'),
    "scenario": _with_index(f', changed as (select district_id, "name", capacity*1.1::double capacity, flow*1.2::double flow, congestion*1.12::double congestion, incidents from raw), after as ({_scored("changed")}) select s.district_id, s."name", s.score "before", a.score "after", round(a.score-s.score,1) delta from scored s join after a using (district_id)'),
    "scenario_summary": _with_index(f', changed as (select district_id, "name", capacity*1.1::double capacity, flow*1.2::double flow, congestion*1.12::double congestion, incidents from raw), after as ({_scored("changed")}) select round(avg(round(a.score-s.score,1)),2) avg_delta, count(*) filter (round(a.score-s.score,1)>0.5) worsened, count(*) filter (round(a.score-s.score,1)<-0.5) improved from scored s join after a using (district_id)'),
    "compare": _with_index(", w(place, district_id) as (values (0,3),(1,12),(2,3),(3,99),(4,7)) select place, r.district_id, \"name\", score, \"rank\", " + ", ".join(f"place=first_value(place) over (order by {c}_part desc, place) leads_{c}" for c in ("capacity", "flow", "congestion", "incidents")) + " from w join ranked r using (district_id)"),
    "regression": _with_trend("select count(*) n, round(any_value(sl),3) slope, round(any_value(ic),1) \"intercept\", round(any_value(r2),6) r2 from t"),
    "forecast": _with_trend(", z as (select max(\"month\") m, max(x) n, any_value(sl) sl, any_value(ic) ic from u), q as (select st::int step, (m+to_months(st::int))::date as \"month\", ic+sl*(n+st) tr from z, range(1,7) g(st)) select step, q.\"month\", round(greatest(tr+coalesce(y.season,0),0),1) forecast, round(greatest(tr,0),1) trend from q left join (select distinct extract(month from \"month\") k, first_value(season) over (partition by extract(month from \"month\") order by \"month\") season from u) y on k=extract(month from q.\"month\")"),
    "forecast_quality": _with_trend("select \"months\", mape, r2, slope, case when mape is null then 'undefined' when mape<10 and r2>0.6 then 'high' when mape<20 then 'acceptable' else 'low' end quality from (select count(*) \"months\", round(avg(abs(volume-trend-season)/nullif(volume,0)*100),1) mape, round(any_value(r2),3) r2, round(any_value(sl),1) slope from u)"),
    "text_functions": "select p_partkey, left(trim(regexp_replace(lower(p_type||' '||p_name),'[^a-z0-9]+','-','g'),'-'),60) slug, case when trim(p_name)='' then '-' when length(p_name)>12 then left(p_name,11)||'…' else p_name end short, case when p_size>25 then 'yes' else 'no' end \"large\", regexp_replace(regexp_replace(cast(p_retailprice as decimal(10,2))::varchar,'(\\.\\d*?)0+$','\\1'),'\\.$','') price from part",
    "wkt_roundtrip": _with("select id, 'POINT ('||regexp_replace(regexp_replace(format('{:.6f}',lon),'(\\.\\d*?)0+$','\\1'),'\\.$','')||' '||regexp_replace(regexp_replace(format('{:.6f}',lat),'(\\.\\d*?)0+$','\\1'),'\\.$','')||')' wkt, 4326::int srid from facility where lon is not null", "facility"),
    "line_metrics": _with(f"select id, round({_KM.format('x', 'y', '(x+0.1)', '(y+0.1)')}+{_KM.format('(x+0.1)', '(y+0.1)', '(x+0.3)', '(y+0.1)')}+{_KM.format('(x+0.3)', '(y+0.1)', '(x+0.3)', '(y+0.4)')},2) km, round(x+0.175,4) mid_lon, round(y+0.15,4) mid_lat, x min_lon, round(y+0.4,2) max_lat, 2::bigint thin from (select id, round(lon,2) x, round(lat,2) y from district)", "district"),
    "chart_series": _with(f"select '['||string_agg('{{\"label\":\"'||strftime(\"month\",'%m.%y')||'\",\"value\":'||cast(volume as decimal(20,2))||'}}', ',' order by \"month\")||']' series from ({_SERIES.format('')})", "flow"),
    "kmeans_assign": "select cluster::int cluster, count(*) vectors from (select v.vec_id, row_number() over (order by c.vec_id)-1 cluster from embeddings v, embeddings c where false union all select vec_id, arg_min(k, g) from (select v.vec_id, c.k, list_sum(list_transform(range(1, len(v.embedding)+1), lambda i: (v.embedding[i]::double-c.embedding[i]::double)*(v.embedding[i]::double-c.embedding[i]::double))) g from embeddings v, (select embedding, row_number() over (order by vec_id)-1 k from (select * from embeddings order by vec_id limit 4)) c) group by 1) group by 1",
    "api_districts": _with("select id, \"name\", region_id, area_sq_km::double area_sq_km, population, lon, lat, population::double/area_sq_km::double density from district order by \"name\" limit 50", "district"),
    "api_objects": _with('select f.id, f."name", f."type", d."name" district, capacity_tons::double capacity, case when f.lon is not null then \'{"type":"Point","coordinates":[\'||f.lon::varchar||\',\'||f.lat::varchar||\']}\' end geometry from facility f join district d on f.district_id=d.id where contains(lower(f."name"),\'street 1\') or contains(lower(coalesce(address,\'\')),\'street 1\') order by f."name", f.id limit 20 offset 20', 'facility', 'district'),
    "api_nearby": _with(f"select id, \"name\", round(km,3) distance_km from (select *, {_KM.format('37.6', '55.7', 'lon', 'lat')} km from facility) where km<=25 order by km, id limit 30", "facility"),
    "api_roads": _with('select r.id, r."name", road_class, district_id, lanes, speed_limit_kmh, case when geom is not null then \'{"type":"LineString","coordinates":[[\'||(37+(30+r.id%60)/100.0)::double::varchar||\',\'||(55+(50+r.id%40)/100.0)::double::varchar||\'],[\'||(37+(31+r.id%60)/100.0)::double::varchar||\',\'||(55+(51+r.id%40)/100.0)::double::varchar||\']]}\' end geometry from road r where road_class=\'arterial\' order by r."name", r.id limit 50', 'road'),
    "api_incidents": _with('select i.id, incident_type, severity, affects_cargo, r."name" road, reported_at, case when lon is not null then \'{"type":"Point","coordinates":[\'||lon::varchar||\',\'||lat::varchar||\']}\' end geometry from incident i left join road r on road_id=r.id where resolved_at is null and severity>=3 and affects_cargo order by reported_at desc, i.id desc limit 50', 'incident', 'road'),
    "api_routes": _with('select id, origin_id, destination_id, route_type, distance_km::bigint distance_km, trucks, case when xs is not null then \'{"type":"LineString","coordinates":[\'||array_to_string([format(\'[{},{}]\', round(37.3+(origin_id%5)*0.12+((destination_id%5)-(origin_id%5))*0.12*i/4,4)::double, round(55.5+(origin_id//5)*0.1+((destination_id//5)-(origin_id//5))*0.1*i/4+0.01*(i%2),4)::double) for i in [0,1,2,3,4]], \',\')||\']}\' end geometry from route where route_type=\'transit\' order by id limit 500', 'route'),
    "api_flows": _with("select id, period_date, district_id, category, direction, volume_tons::double volume, vehicle_count from flow where direction='R' and period_date between date '1996-01-01' and date '1996-12-31' order by period_date desc, id limit 100", "flow"),
    "api_etl_runs": _with("select r.id, s.\"name\" \"source\", status, records_loaded, records_errors from run r left join source s on r.source_id=s.id order by r.id desc limit 50", "run", "source"),
    "api_traffic_current": _with(f"select r.id road_id, r.\"name\", l.\"level\", {_STATE.format('l.\"level\"')} state, case when l.\"level\">=9 then 'crit' when l.\"level\">=7 then 'alert' when l.\"level\">=5 then 'warn' else 'ok' end tone from road r join ({_LATEST}) l on l.road_id=r.id where district_id=7", "road", "condition"),
    "same_road_incidents": _with("select a.id, b.id other_id, row_number() over (partition by a.id order by b.reported_at desc, b.id desc)::int as \"rank\" from incident a join incident b on a.road_id=b.road_id and a.id<>b.id qualify \"rank\"<=6", "incident"),
    "reference_counts": _with("select count(*) total, 'districts' dimension from district union all select count(distinct \"type\"), 'types' from facility union all select count(*), 'categories' from category union all select count(*), 'sources' from source", "district", "facility", "category", "source"),
    "export_districts": _with(f"select \"name\" district, area_sq_km area, population, objects, capacity, volume, vehicles, road_km, congestion, {_STATE.format('congestion')} state from ({_PROFILE})", *_PROFILE_VIEWS),
    "export_roads": _with(f"select r.\"name\", road_class, d.\"name\" district, length_km::double length, lanes, speed_limit_kmh, l.\"level\", l.speed, recorded_at from road r left join district d on r.district_id=d.id left join ({_LATEST}) l on l.road_id=r.id", "road", "district", "condition"),
    "export_incidents": _with("select i.id, incident_type, severity, ['minor','moderate','serious','severe','critical'][severity] \"label\", r.\"name\" road, d.\"name\" district, reported_at, resolved_at, round_even((epoch_us(coalesce(resolved_at,tick))-epoch_us(reported_at))::double/3.6e9::double,1) \"hours\", affects_cargo from clock, incident i left join road r on road_id=r.id left join district d on r.district_id=d.id", "incident", "road", "district", "clock"),
    "export_flows": _with("select f.id, strftime(period_date,'%m.%Y') period, case direction when 'A' then 'arrival' when 'N' then 'transfer' else 'return' end direction, d.\"name\" district, category, volume_tons::double volume, vehicle_count, avg_speed_kmh from flow f left join district d on f.district_id=d.id", "flow", "district"),
    "export_routes": _with("select r.id, route_type, o.\"name\" origin, e.\"name\" destination, distance_km::bigint distance_km, duration_h::bigint duration_h, trucks from route r join district o on origin_id=o.id join district e on destination_id=e.id", "route", "district"),
    "export_totals": _with("select unnest(['roads','road km']) \"name\", unnest([count(*)::double, sum(length_km)::double]) \"value\" from road union all select unnest(['incidents','open incidents','cargo incidents']), unnest([count(*)::double, (count(*) filter (resolved_at is null))::double, (count(*) filter (affects_cargo))::double]) from incident union all select unnest(['flows','volume','vehicles']), unnest([count(*)::double, sum(volume_tons)::double, sum(vehicle_count)::double]) from flow union all select unnest(['routes','trucks']), unnest([count(*)::double, sum(trucks)::double]) from route", "road", "incident", "flow", "route"),
    "facility_layer": _with("select '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":['||lon::varchar||','||lat::varchar||']},\"properties\":{\"id\":'||id||',\"name\":\"'||\"name\"||'\",\"type\":\"'||\"type\"||'\"}}' feature from (select * from facility where lon is not null order by id limit 5000)", "facility"),
    "district_layer": _with(f"select '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":['||lon::varchar||','||lat::varchar||']}},\"properties\":{{\"district_id\":'||district_id||',\"name\":\"'||\"name\"||'\",\"objects\":'||objects||',\"incidents\":'||incidents||'}}}}' feature from ({_PROFILE})", *_PROFILE_VIEWS),
    "route_layer": _with('select \'{"type":"Feature","geometry":\'||\'{"type":"LineString","coordinates":[[\'||xs[1]::varchar||\',\'||ys[1]::varchar||\'],[\'||xs[2]::varchar||\',\'||ys[2]::varchar||\'],[\'||xs[3]::varchar||\',\'||ys[3]::varchar||\']]}\'||\',"properties":{"id":\'||id||\',"route_type":"\'||route_type||\'","trucks":\'||trucks||\'}}\' feature from route where xs is not null order by id limit 5000', 'route'),
    "layer_collection": _with("""select '{"type":"FeatureCollection","count":'||count(*)||',"features":['||string_agg(feature, ',' order by district_id)||']}' "collection" from (select district_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":['||lon::varchar||','||lat::varchar||']},"properties":{"district_id":'||district_id||',"name":"'||"name"||'","objects":'||objects||',"incidents":'||incidents||'}}' feature from (PROFILE))""".replace("PROFILE", _PROFILE), *_PROFILE_VIEWS),
    "road_layer": _with(f"select '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[['||(37+(30+r.id%60)/100.0)::double::varchar||','||(55+(50+r.id%40)/100.0)::double::varchar||'],['||(37+(31+r.id%60)/100.0)::double::varchar||','||(55+(51+r.id%40)/100.0)::double::varchar||']]}},\"properties\":{{\"id\":'||r.id||',\"name\":\"'||r.\"name\"||'\"'||coalesce(',\"level\":'||\"level\"||',\"state\":\"'||{_STATE.format('\"level\"')}||'\"','')||'}}}}' feature from road r left join ({_LATEST}) l on l.road_id=r.id where geom is not null", "road", "condition"),
    "api_district_summary": _with(_PROFILE, *_PROFILE_VIEWS),
    "api_types": _with('select "type", count(*) objects, coalesce(sum(capacity_tons),0)::double capacity from facility group by 1', "facility"),
    "api_sources": _with('select id, "name", is_active from source', "source"),
    "api_cargo_categories": _with('select "name", hazard_class, hazard_class>0 is_hazardous, [\'not hazardous\',\'explosives\',\'gases\',\'flammable liquids\',\'flammable solids\',\'oxidisers\',\'toxic substances\',\'radioactive material\',\'corrosives\',\'other hazards\'][hazard_class+1] hazard_label from category', "category"),
    "api_object_detail": _with('select f.id, f."name", f."type", d."name" district, address, operating_hours, capacity_tons::double capacity, f.lon, f.lat from facility f join district d on f.district_id=d.id where f.id=42', "facility", "district"),
    "api_load_index": _with_index('select "rank", district_id, "name", score, capacity_part, flow_part, congestion_part, incidents_part, capacity, flow, congestion, incidents from ranked'),
    "api_object_list": _with('select n "count", greatest(1,(n+19)//20)::bigint pages, 2::bigint page, case when greatest(1,(n+19)//20)>2 then 3::bigint end as "next", 1::bigint previous, (select to_json(list({\'id\':id,\'name\':"name",\'type\':"type",\'district\':district,\'capacity\':capacity,\'geometry\':geometry} order by "name", id))::varchar from (select f.id, f."name", f."type", d."name" district, capacity_tons::double capacity, case when f.lon is not null then \'{"type":"Point","coordinates":[\'||f.lon::varchar||\',\'||f.lat::varchar||\']}\' end geometry from facility f join district d on f.district_id=d.id order by f."name", f.id limit 20 offset 20)) results from (select count(*) n from facility)', 'facility', 'district'),
    "api_forecast_district": _with_trend(", z as (select max(\"month\") m, max(x) n, any_value(sl) sl, any_value(ic) ic from u), q as (select st::int step, (m+to_months(st::int))::date as \"month\", ic+sl*(n+st) tr from z, range(1,5) g(st)) select step, q.\"month\", round(greatest(tr+coalesce(y.season,0),0),1) forecast, round(greatest(tr,0),1) trend from q left join (select distinct extract(month from \"month\") k, first_value(season) over (partition by extract(month from \"month\") order by \"month\") season from u) y on k=extract(month from q.\"month\")", "where district_id=7"),
    "incident_layer": _with('select \'{"type":"Feature","geometry":\'||\'{"type":"Point","coordinates":[\'||lon::varchar||\',\'||lat::varchar||\']}\'||\',"properties":{"id":\'||id||\',"incident_type":"\'||incident_type||\'","severity":\'||severity||\',"is_open":\'||(resolved_at is null)::varchar||\'}}\' feature from (select * from incident where lon is not null order by reported_at desc, id desc limit 5000)', 'incident'),
    "open_incident_layer": _with('select \'{"type":"Feature","geometry":\'||\'{"type":"Point","coordinates":[\'||lon::varchar||\',\'||lat::varchar||\']}\'||\',"properties":{"id":\'||id||\',"incident_type":"\'||incident_type||\'","severity":\'||severity||\',"is_open":\'||(resolved_at is null)::varchar||\'}}\' feature from (select * from incident where lon is not null and resolved_at is null and affects_cargo order by reported_at desc, id desc limit 5000)', 'incident'),
    "titled_features": _with('select \'{"type":"Feature","geometry":\'||\'{"type":"LineString","coordinates":[[\'||(37+(30+r.id%60)/100.0)::double::varchar||\',\'||(55+(50+r.id%40)/100.0)::double::varchar||\'],[\'||(37+(31+r.id%60)/100.0)::double::varchar||\',\'||(55+(51+r.id%40)/100.0)::double::varchar||\']]}\'||\',"properties":{"Name":"\'||r."name"||\'","Lanes":"\'||lanes||\'","Length, km":"\'||(1+r.id%40)||\'"}}\' feature from road r where geom is not null', 'road'),
    "area_layer": 'select \'{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[\'||\'[\'||\'[\'||round(x+-0.03,4)::double::varchar||\',\'||round(y+-0.03,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.03,4)::double::varchar||\',\'||round(y+-0.03,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.03,4)::double::varchar||\',\'||round(y+0.03,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+-0.03,4)::double::varchar||\',\'||round(y+0.03,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+-0.03,4)::double::varchar||\',\'||round(y+-0.03,4)::double::varchar||\']\'||\']\'||case when n%3=0 then \',\'||\'[\'||\'[\'||round(x+-0.01,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.01,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.01,4)::double::varchar||\',\'||round(y+0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+-0.01,4)::double::varchar||\',\'||round(y+0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+-0.01,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\']\' else \'\' end||\']\'||case when n%4=0 then \',[\'||\'[\'||\'[\'||round(x+0.04,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.060000000000000005,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.060000000000000005,4)::double::varchar||\',\'||round(y+0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.04,4)::double::varchar||\',\'||round(y+0.01,4)::double::varchar||\']\'||\',\'||\'[\'||round(x+0.04,4)::double::varchar||\',\'||round(y+-0.01,4)::double::varchar||\']\'||\']\'||\']\' else \'\' end||\']},"properties":{"id":\'||n||\',"name":"\'||n_name||\'"}}\' feature from (select n_nationkey n, n_name, cast(37.3 as double)+cast(n_nationkey%5 as double)*cast(0.12 as double) x, cast(55.5 as double)+cast(n_nationkey//5 as double)*cast(0.1 as double) y from nation) where n%8<>7',
    "report_note": _with("select n total, least(n,400)::bigint shown, greatest(n-400,0)::bigint left_out, case when n>400 then 'The first '||least(n,400)||' of '||n||' rows are shown.' end note from (select count(*) n from run)", 'run'),
    "run_states": _with('select status, count(*) runs from run group by 1', 'run'),
    "geojson_head": _with('select \'{"type":"FeatureCollection","name":"Roads","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"metadata":{"system":"freightlens","generated_at":"\'||strftime(tick,\'%Y-%m-%dT%H:%M:%S\')||\'","count":\'||n||\'}}\' head from clock, (select count(geom) n from road)', 'clock', 'road'),
    "forecast_chart": _with_trend(""", z as (select max("month") m, max(x) n, any_value(sl) sl, any_value(ic) ic from u), q as (select (m+to_months(st::int))::date as "month", ic+sl*(n+st) tr from z, range(1,7) g(st)), p as (select q."month", null fact, round(greatest(tr+coalesce(y.season,0),0),1) predicted from q left join (select distinct extract(month from "month") k, first_value(season) over (partition by extract(month from "month") order by "month") season from u) y on k=extract(month from q."month") union all select "month", volume, case when "month"=m then volume end from u, z) select '{"labels":['||string_agg('"'||strftime("month",'%m.%y')||'"', ',' order by "month")||'],"fact":['||string_agg(coalesce(cast(fact as decimal(20,2))::varchar,'null'), ',' order by "month")||'],"predicted":['||string_agg(coalesce(cast(predicted as decimal(20,2))::varchar,'null'), ',' order by "month")||']}' chart from p"""),
}
ORACLES["quality_total"] = ORACLES["quality_checks"].replace('select "rule", found, total,', 'select sum(found)::bigint issues_total from (select "rule", found, total,', 1) + ")"

def _deep_page(number: str) -> str:
    return _with(f'select id, "name", capacity_tons::double capacity from (select *, row_number() over (order by capacity_tons desc nulls last, id)-1 place, (count(*) over ()+24)//25 pages from facility) where place//25+1=({number})', "facility")


ORACLES |= {"deep_page_first": _deep_page("1"), "deep_page_middle": _deep_page("(pages+1)//2"), "deep_page_last": _deep_page("pages")}
ORACLES |= {"box_indexed": ORACLES["bbox_filter"], "nearest_indexed": ORACLES["nearest_radius"]}
_ORDERS = {"district": "id", "facility": '"name", id', "road": '"name", id', "route": "id", "flow": "period_date desc, id", "condition": "recorded_at desc, id", "incident": "reported_at desc, id", "run": "started_at desc, id"}
ORACLES["default_orders"] = _with(" union all ".join(f"(select '{'flow_lines' if t == 'flow' else t}' entity, (row_number() over (order by {o})-1)::int place, id::bigint id from {t} qualify place<5)" for t, o in _ORDERS.items()), *_ORDERS)
ORACLES["district_types"] = _with('select d."name" district, "type", count(*) objects, coalesce(sum(capacity_tons),0)::double capacity from facility f join district d on f.district_id=d.id where d.id=7 group by 1,2', "facility", "district")
ORACLES["monthly_incremental"] = ORACLES["flow_timeseries"]
ORACLES["congestion_episodes"] = _with(
    """, marks as (select road_id, recorded_at a, recorded_at+to_hours(case when "level">=9 then 6 else 3 end) e, "level" from condition where "level">=7),
    runs as (select *, max(e) over (partition by road_id order by a, e rows between unbounded preceding and 1 preceding) reach from marks),
    islands as (select *, count(*) filter (reach is null or a>reach) over (partition by road_id order by a, e rows unbounded preceding) n from runs)
    select road_id, min(a) began, max(e) ends, count(*) samples, max("level") worst from islands group by road_id, n""", "condition").replace(") ,", "),")
ORACLES["script_roundtrip"] = _with('select id::int id, "name", lanes, length_km::double length_km, district_id from road', "road")
ORACLES["roads_in_box"] = _with('select id, "name" from road where geom is not null and 37+(30+id%60)/100.0<=37.7 and 37+(31+id%60)/100.0>=37.4 and 55+(50+id%40)/100.0<=55.8 and 55+(51+id%40)/100.0>=55.6', "road")
ORACLES["trigram_search"] = _with("select id, \"name\", address from facility where contains(lower(\"name\"),'eet 4') or contains(lower(coalesce(address,'')),'eet 4')", "facility")
ORACLES = {name: _spelled(sql) for name, sql in ORACLES.items()}
