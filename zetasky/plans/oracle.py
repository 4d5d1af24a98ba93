"""Independent SQL for DuckDB: the same measurement written from the formulas, as common table expressions."""

from __future__ import annotations

from zetasky.sources.fixture import GOLDEN_ANGLE, N_MAPS, N_ZBINS, PARAMS

N, NPIX = PARAMS.nside, PARAMS.npix
CAP = 2 * N * (N - 1)
EDGES = PARAMS.edges()


def e(x: float) -> str:
    """A double literal."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def sky_of(pix: str, n: int = N) -> dict[str, str]:
    """Ring, step, z, phi and theta of a pixel number, by region."""
    cap, total = 2 * n * (n - 1), 12 * n * n
    i_n, i_s, q = f"floor((1+floor(sqrt(1+2*{pix})))/2)", f"floor((1+floor(sqrt(2*({total}-{pix})-1)))/2)", f"({pix}-{cap})"
    i_b = f"(floor({q}/{4 * n})+{n})"
    region = lambda north, belt, south: f"case when {pix}<{cap} then {north} when {pix}<{total - cap} then {belt} else {south} end"
    phi_n = f"({pix}+1-2*{i_n}*({i_n}-1)-5e-1)*pi()/(2*{i_n})"
    phi_s = f"(4*{i_s}+1-({total}-{pix}-2*{i_s}*({i_s}-1))-5e-1)*pi()/(2*{i_s})"
    phi_b = f"({q}%{4 * n}+1-case when ({i_b}+{n})%2=1 then 1e0 else 5e-1 end)*pi()/{2 * n}"
    u = lambda i: f"({i}*{i}/{3 * n * n}e0)"
    cap_theta = lambda i, sign: f"atan2(sqrt({u(i)}*(2-{u(i)})),{sign}(1-{u(i)}))"
    z_b = f"(2*({2 * n}-{i_b})/{3 * n}e0)"
    return {"ra": region(phi_n, phi_b, phi_s), "theta": region(cap_theta(i_n, ""), f"atan2(sqrt(1-{z_b}*{z_b}),{z_b})", cap_theta(i_s, "-"))}


def pixel_at(phi: str, theta: str, n: int = N) -> str:
    """Pixel number of a point."""
    cap, total = 2 * n * (n - 1), 12 * n * n
    z = f"cos({theta})"
    t = f"(({phi}-floor({phi}/(2*pi()))*(2*pi()))*2/pi())"
    jp, jm = (f"floor({n}*(5e-1+{t}){s}75e-2*{n}*{z})" for s in "-+")
    ir = f"({n}+1+{jp}-{jm})"
    ip = f"(cast(floor(({jp}+{jm}-{n}+(1-{ir}%2)+1)/2) as bigint)%{4 * n}+{4 * n})%{4 * n}"
    tp, m = f"({t}-floor({t}))", f"({n}*sqrt(3*(1-abs({z}))))"
    kp, km = f"floor({tp}*{m})", f"floor((1-{tp})*{m})"
    kr = f"({kp}+{km}+1)"
    kk = f"(floor({t}*{kr})%(4*{kr}))"
    return f"cast(case when abs({z})<=2e0/3e0 then {cap}+({ir}-1)*{4 * n}+({ip}) when {z}>0 then 2*{kr}*({kr}-1)+{kk} else {total}-2*{kr}*({kr}+1)+{kk} end as bigint)"


def cos_sep(a: str, b: str) -> str:
    ra_a, dec_a, ra_b, dec_b = *a.split(), *b.split()
    return f"(cos({ra_a}-{ra_b})*cos({dec_a})*cos({dec_b})+sin({dec_a})*sin({dec_b}))"


def acos_of(c: str) -> str:
    return f"acos(greatest(-1e0,least(1e0,{c})))"


_s = sky_of("p")
_c = sky_of("center_pix")
R, FR, TQ = (f"radians({e(x)}/60)" for x in (PARAMS.patch_size, PARAMS.filter_radius, PARAMS.theta_q))
BIN = "case " + " ".join(f"when d>{e(a)} and d<{e(b)} then {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " end"

CTES = {
    "shear": f"select cast(l_linenumber%{N_MAPS} as int) as map_id, cast(l_suppkey%{N_ZBINS} as int) as zbin, (l_orderkey*7919+l_linenumber*104729+l_partkey*31)%{NPIX} as pix, sum(l_quantity*(l_discount-5e-2))/sum(l_quantity) as g1, sum(l_quantity*(l_tax-4e-2))/sum(l_quantity) as g2, sum(l_quantity) as w from lineitem group by 1,2,3",
    "pixels": f"select p as pix, {_s['ra']} as ra, pi()/2-({_s['theta']}) as dec from (select cast(range as bigint) as p from range({NPIX}))",
    "patches": f"select cast(s_suppkey as int) as patch_id, s_suppkey*{e(GOLDEN_ANGLE)}-floor(s_suppkey*{e(GOLDEN_ANGLE)}/(2*pi()))*(2*pi()) as phi_center, acos(1-2*(s_acctbal+1000)/11000) as theta_center from supplier",
    "mask": f"select (o_orderkey*7919+o_custkey*31)%{NPIX} as pix, cast(count(*)%7 as double) as m from orders group by 1",
    "points": "select l_orderkey, l_linenumber, l_quantity*37e-2 as ra1, l_discount*3e0-3e-1 as dec1, l_extendedprice*73e-5+1e-1 as ra2, l_tax*5e0+5e-1 as dec2, radians(l_quantity*l_discount*2513e-1/60) as theta from lineitem",
    "members": f"select patch_id, pix, ra, dec from pixels join patches on sin(theta_center)*cos(phi_center)*cos(dec)*cos(ra)+sin(theta_center)*sin(phi_center)*cos(dec)*sin(ra)+cos(theta_center)*sin(dec)>=cos({R})",
    "candidates": f"select a.patch_id, a.pix as pix1, b.pix as pix2, a.ra as ra1, a.dec as dec1, b.ra as ra2, b.dec as dec2, {acos_of(cos_sep('a.ra a.dec', 'b.ra b.dec'))} as d, {cos_sep('a.ra a.dec', 'b.ra b.dec')} as c, cos(a.dec)*cos(b.dec)*sin(b.ra-a.ra) as s from members a join members b on a.patch_id=b.patch_id and a.pix<b.pix",
    "binned": f"select *, cast({BIN} as int) as bin, sin(dec2)-sin(dec1)*c as q1, sin(dec1)-sin(dec2)*c as q2 from candidates",
    "pairs": "select patch_id, bin, pix1, pix2, (s*s-q1*q1)/(q1*q1+s*s) as e1_re, 2*q1*s/(q1*q1+s*s) as e1_im, (s*s-q2*q2)/(q2*q2+s*s) as e2_re, -2*q2*s/(q2*q2+s*s) as e2_im from binned where bin is not null",
    "bins": f"select cast(range as int) as bin from range({PARAMS.nbins})",
    "counts": "select p.patch_id, b.bin, count(x.pix1) as npairs from patches p cross join bins b left join pairs x on x.patch_id=p.patch_id and x.bin=b.bin group by 1,2",
    "snapped": f"select patch_id, center_pix, {_c['ra']} as ra_c, pi()/2-({_c['theta']}) as dec_c, phi_center, theta_center from (select *, {pixel_at('phi_center', 'theta_center')} as center_pix from patches)",
    "disc": f"select patch_id, pix, ra, dec, ra_c, dec_c, center_pix, greatest(-1e0,least(1e0,{cos_sep('ra dec', 'ra_c dec_c')})) as c from pixels join snapped on sin(theta_center)*cos(phi_center)*cos(dec)*cos(ra)+sin(theta_center)*sin(phi_center)*cos(dec)*sin(ra)+cos(theta_center)*sin(dec)>=cos({FR})",
    "angles": "select patch_id, pix, acos(c) as t, sin(ra-ra_c)*cos(dec)/sqrt(1-c*c) as cp, (cos(dec)*sin(dec_c)-sin(dec)*cos(dec_c)*cos(ra-ra_c))/sqrt(1-c*c) as sp from disc where pix<>center_pix",
    "filters": f"select patch_id, pix, cp*cp-sp*sp as q_cos, 2*sp*cp as q_sin, t*t/(4*pi()*pow({TQ},4))*exp(-t*t/(2*{TQ}*{TQ})) as q_val from angles",
    "areas": f"select patch_id, count(*) as n_pix, count(*)*4*pi()/{NPIX} as area from filters group by 1",
    "masses": "select map_id, zbin, f.patch_id, any_value(area)*sum(w*(-g1*q_cos-g2*q_sin)*q_val)/sum(w) as m_ap from filters f join shear using (pix) join areas a on a.patch_id=f.patch_id group by 1,2,3",
    "half": "select x.patch_id, x.bin, pix1, pix2, e2_re, e2_im, a.map_id, a.zbin as za, a.w as wa, a.g1*e1_re-a.g2*e1_im as r1, a.g1*e1_im+a.g2*e1_re as i1 from pairs x join shear a on a.pix=pix1",
    "ends": "select h.patch_id, h.bin, pix1, pix2, h.map_id, za, b.zbin as zb, wa*b.w as ww, r1, i1, b.g1*e2_re-b.g2*e2_im as r2, b.g1*e2_im+b.g2*e2_re as i2 from half h join shear b on b.pix=pix2 and b.map_id=h.map_id",
    "zpairs": "select a.zbin as z1, b.zbin as z2 from (select distinct zbin from shear) a join (select distinct zbin from shear) b on a.zbin<=b.zbin",
    "forward": "select map_id, za as z1, zb as z2, patch_id, bin, sum(ww) as w, sum(ww*(r1*r2+i1*i2)) as p, sum(ww*(r1*r2-i1*i2)) as m, sum(r1*r2+i1*i2) as up, sum(r1*r2-i1*i2) as um from ends where za<=zb group by all",
    "swapped": "select map_id, zb as z1, za as z2, patch_id, bin, sum(ww) as w, sum(ww*(r1*r2+i1*i2)) as p, sum(ww*(r1*r2-i1*i2)) as m from ends where za>zb group by all",
    "grid": "select map_id, z1, z2, patch_id, bin, npairs from (select distinct map_id from shear) cross join zpairs cross join counts",
    "xi": "select g.map_id, g.z1, g.z2, g.patch_id, g.bin, npairs, coalesce(f.w,0)+coalesce(s.w,0) as sumw, case when g.z1=g.z2 then f.p/nullif(f.w,0) else (f.p/nullif(f.w,0)+s.p/nullif(s.w,0))/2 end as xip, case when g.z1=g.z2 then f.m/nullif(f.w,0) else (f.m/nullif(f.w,0)+s.m/nullif(s.w,0))/2 end as xim, f.p/nullif(f.w,0) as fp, f.m/nullif(f.w,0) as fm, coalesce(f.w,0) as fw, coalesce(f.up,0)/nullif(npairs,0) as up, coalesce(f.um,0)/nullif(npairs,0) as um from grid g left join forward f using (map_id,z1,z2,patch_id,bin) left join swapped s using (map_id,z1,z2,patch_id,bin)",
    "zetas": "select x.map_id, m.zbin as z1, x.z1 as z2, x.z2 as z3, x.bin, covar_pop(m_ap,xip) as zetap, covar_pop(m_ap,xim) as zetam from xi x join masses m on m.map_id=x.map_id and m.patch_id=x.patch_id and m.zbin<=x.z1 group by 1,2,3,4,5",
    "samples": "select l_quantity as x, l_extendedprice as y from lineitem where l_quantity is not null and l_extendedprice is not null",
    "cells": "select cast(least(floor((x-lx)/(hx-lx)*20),19) as int) as ix, cast(least(floor((y-ly)/(hy-ly)*20),19) as int) as iy, count(*) as n from samples, (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from samples) group by 1,2",
    "taps": "select cast(range-2 as int) as step, exp(-5e-1*pow((range-2)/5e-1,2))/(select sum(exp(-5e-1*pow((range-2)/5e-1,2))) from range(5)) as wt from range(5)",
    "axis": "select cast(range as int) as i, case when range+step<0 then -(range+step)-1 when range+step>=20 then 40-(range+step)-1 else range+step end as src, sum(wt) as wt from range(20), taps group by 1,2",
    "smooth": "select a.i as ix, b.i as iy, coalesce(sum(c.n*a.wt*b.wt),0) as density from axis a cross join axis b left join cells c on c.ix=a.src and c.iy=b.src group by 1,2",
    "stats": "select count(*) as n, min(y) as lo, max(y) as hi, quantile_cont(y,75e-2)-quantile_cont(y,25e-2) as iqr from samples",
    "ready": "select *, cast(ceil((hi-lo)/least(2*iqr/pow(n,1e0/3e0),(hi-lo)/(log2(n)+1))) as int) as nb from stats",
    "hist": "select cast(least(floor((y-lo)/(hi-lo)*nb),nb-1) as int) as bin, count(*) as n from samples, ready group by 1",
    "hist1d": "select cast(k.i as int) as bin, lo+(k.i+5e-1)*((hi-lo)/nb) as center, coalesce(h.n,0) as count, coalesce(h.n,0)/(r.n*((hi-lo)/nb)) as density from ready r, lateral (select unnest(range(nb)) as i) k left join hist h on h.bin=k.i",
}

#: What each expression reads; "" marks the ones over base tables or ranges alone.
NEEDS = {
    "members": "pixels patches", "candidates": "members", "binned": "candidates", "pairs": "binned", "counts": "patches bins pairs", "snapped": "patches", "disc": "pixels snapped",
    "angles": "disc", "filters": "angles", "areas": "filters", "masses": "filters shear areas", "half": "pairs shear", "ends": "half shear", "forward": "ends", "swapped": "ends", "zpairs": "shear", "grid": "shear zpairs counts",
    "xi": "grid forward swapped", "zetas": "xi masses", "cells": "samples", "axis": "taps", "smooth": "axis cells", "stats": "samples", "ready": "stats", "hist": "samples ready", "hist1d": "ready hist",
}


#: Computed once, in this order: a planner might else join the fields of two pixels by map before it looks at pairs.
ONCE = {"shear", "pairs", "half"}


def sql(query: str, *needs: str, **instead: str) -> str:
    """``query`` with all the expressions that it needs, directly or not, some of them put ``instead`` of the usual ones."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, "").split():
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    return ("with " + ", ".join(f"{n} as {'materialized ' * (n in ONCE)}({instead.get(n, CTES[n])})" for n in wanted) + " " if wanted else "") + query
