"""The 90 cross-source indicators, as SQL over metric columns. Formulas, families and directions.

per(a, b, k) is a / b * k where b is above 0; each(a, b) is a / (b + 1); plus(x) is x, or 0 where it is below.
"""

from __future__ import annotations

import re

from fieldglass.operators.ranking import Indicator

SPEC = """
J01 service_gap lower per(bh, kids, 10000)
J02 service_gap lower per(bh, kids_0_5, 10000)
J03 service_gap higher each(dis, bh)
J04 service_gap higher each(cog, bh)
J05 service_gap higher each(dis, therapy)
J06 service_gap higher each(kids, psychiatry)
J07 service_gap higher each(kids, centers)
J08 service_gap higher shortage * each(kids, bh)
J09 service_gap higher plus(1 + growth) * each(kids, bh)
J10 service_gap higher miles_bh
J11 referral_network higher per(physicians, kids, 10000)
J12 referral_network higher per(therapy, kids, 10000)
J13 referral_network higher per(sites, kids_0_5, 1000)
J14 referral_network higher per(daycare, kids_0_5, 1000)
J15 referral_network higher per(hospitals, kids, 100000)
J16 referral_network higher per(schools_private, kids_6_17, 10000)
J17 referral_network higher per(disability_orgs, dis, 1000)
J18 referral_network higher each(sites + therapy, bh)
J19 payer_fit higher each(employer, bh)
J20 payer_fit higher each(medicaid, bh)
J21 payer_fit higher per(employer, under19, 1) * (1 - pov_model / 100)
J22 payer_fit higher CASE WHEN abs(per(uninsured, under19, 100) - unins_model) <= 4 THEN 100 - (per(uninsured, under19, 100) + unins_model) / 2 END
J23 payer_fit higher per(family_income, income_model, 1)
J24 payer_fit higher each(kids * pov_model / 100, bh)
J25 payer_fit higher each(kids_0_5 * per(employer, under19, 1), bh)
J26 payer_fit higher per(working_0_5, capacity, 1)
J27 access higher per(kids, sqmi, 1)
J28 access higher each(sqmi, bh)
J29 access higher per(no_car, households, 1) * each(kids, bh)
J30 access higher per(minutes, commuters, 1) * each(kids, bh) / 100
J31 access higher per(internet, households, 1) * each(sqmi, bh)
J32 access higher per(lep, households, 1) * each(kids, bh)
J33 access higher shortage * per(sqmi, kids, 1000)
J34 need_intensity higher per(dis, dis_base, 100) * pov_model / 100
J35 need_intensity higher each(dis_u5, therapy)
J36 need_intensity lower per(disability_orgs + dd_homes, cog, 1000)
J37 validation agreement plus(floor(100.5 - 5 * abs(per(poor_kids, pov_base, 100) - pov_model)))
J38 validation agreement plus(floor(100.5 - 8 * abs(per(uninsured, under19, 100) - unins_model)))
J39 validation agreement plus(floor(100.5 - 200 * abs(per(under19, model_base, 1) - 1)))
J40 validation agreement floor(100.5 - abs(pct_daycare - pct_sites))
J41 service_gap lower per(aba, kids, 10000)
J42 service_gap lower per(aba, kids_0_5, 10000)
J43 service_gap higher each(dis, aba)
J44 service_gap higher each(cog, aba)
J45 service_gap higher each(medicaid, aba)
J46 service_gap higher each(employer, aba)
J47 service_gap higher each(poor_kids, aba)
J48 service_gap higher plus(1 + growth) * each(kids, aba)
J49 service_gap higher shortage * each(kids, aba)
J50 service_gap higher miles_aba
J51 service_gap higher each(sqmi, aba)
J52 service_gap higher per(no_car, households, 1) * each(kids, aba)
J53 service_gap higher per(minutes, commuters, 1) * each(kids, aba) / 100
J54 service_gap higher per(lep, households, 1) * each(kids, aba)
J55 service_gap higher per(internet, households, 1) * each(sqmi, aba)
J56 service_gap higher each(kids_3_17 * 0.0322, aba)
J57 service_gap higher each(kids, dev_peds)
J58 service_gap higher each(kids, psychologists)
J59 service_gap higher each(dis, slp)
J60 service_gap higher each(dis_u5, ot)
J61 referral_network higher per(pediatrics, kids, 10000)
J62 referral_network higher CASE WHEN kids IS NOT NULL THEN each(pediatrics, aba) END
J63 referral_network higher CASE WHEN kids IS NOT NULL THEN each(slp + ot, aba) END
J64 referral_network higher per(map_childcare, kids_0_5, 1000)
J65 referral_network higher per(map_schools, kids_6_17, 10000)
J66 referral_network higher per(map_clinics, kids, 10000)
J67 referral_network higher per(map_hospitals, kids, 100000)
J68 referral_network higher each(sites, aba)
J69 referral_network higher each(capacity, aba)
J70 referral_network higher each(pediatrics + slp + ot + map_childcare, aba)
J71 referral_network higher per(dev_peds + psychologists, kids, 10000)
J72 referral_network higher each(map_schools, aba)
J73 payer_fit higher each(employer + medicaid, aba)
J74 payer_fit higher each(kids_0_5 * per(employer, under19, 1), aba)
J75 payer_fit higher each(kids_0_5 * per(medicaid, under19, 1), aba)
J76 payer_fit higher each(working_0_5, aba)
J77 payer_fit higher each(family_households * per(family_income, income, 1), aba)
J78 access higher per(kids, sqmi, 1) / (per(aba, kids, 10000) + 1)
J79 access higher each(shortage * sqmi, aba)
J80 access higher per(sites, sqmi, 1)
J81 need_intensity higher each(dis, dev_peds + psychologists)
J82 need_intensity higher each(dis_u5, pediatrics)
J83 need_intensity higher each(cog, psychologists)
J84 need_intensity higher each(kids_3_17 * 0.0322, dev_peds + psychologists)
J85 validation agreement floor(100.5 - abs(pct_map_childcare - pct_sites))
J86 validation agreement floor(100.5 - abs(pct_aba - pct_map_aba))
J87 validation agreement floor(100.5 - abs(pct_pediatrics - pct_map_clinics))
J88 validation agreement floor(100.5 - abs(pct_aba - pct_bh))
J89 validation agreement floor(100.5 - abs(pct_map_hospitals - pct_hospitals))
J90 validation agreement floor(100.5 - abs(pct_slp_ot - pct_map_therapy))
"""

#: Supply for each child whose percentiles the agreements compare: name, numerator, denominator.
SHARES = {
    "pct_daycare": ("daycare", "kids_0_5"), "pct_sites": ("sites", "kids_0_5"), "pct_map_childcare": ("map_childcare", "kids_0_5"), "pct_aba": ("aba", "kids"), "pct_map_aba": ("map_aba", "kids"),
    "pct_pediatrics": ("pediatrics", "kids"), "pct_map_clinics": ("map_clinics", "kids"), "pct_bh": ("bh", "kids"), "pct_map_hospitals": ("map_hospitals", "kids"), "pct_hospitals": ("hospitals", "kids"),
    "pct_slp_ot": ("slp + ot", "kids"), "pct_map_therapy": ("map_therapy", "kids"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at `at`, and where it closes."""
    depth, start, out = 0, at + 1, []
    for k in range(at, len(text)):
        if text[k] == "(":
            depth += 1
        elif text[k] == ")":
            depth -= 1
            if depth == 0:
                return [*out, text[start:k].strip()], k
        elif text[k] == "," and depth == 1:
            out.append(text[start:k].strip())
            start = k + 1
    raise ValueError(text)


def expand(text: str) -> str:
    """per(), each() and plus() written out."""
    while m := re.search(r"\b(per|each|plus)\(", text):
        args, end = _arguments(text, m.end() - 1)
        if m[1] == "plus":
            new = f"(CASE WHEN {args[0]} < 0 THEN 0.0E0 ELSE {args[0]} END)"
        elif m[1] == "per":
            a, b, k = args
            new = f"(CASE WHEN ({b}) > 0 THEN ({a}) * 1.0E0 / ({b}) * {k} END)"
        else:
            a, b = args
            new = f"(({a}) * 1.0E0 / (({b}) + 1))"
        text = text[: m.start()] + new + text[end + 1 :]
    return text


_WORDS = {"per", "each", "plus", "abs", "floor", "CASE", "WHEN", "THEN", "END", "IS", "NOT", "NULL"}
INDICATORS: list[Indicator] = []
for _line in SPEC.strip().splitlines():
    _id, _family, _direction, _formula = _line.split(" ", 3)
    _metrics = tuple(dict.fromkeys(w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", _formula) if w not in _WORDS))
    _tested = " AND ".join(f"{m} IS NOT NULL" for m in _metrics)
    INDICATORS.append(Indicator(_id, _family, f"CASE WHEN {_tested} THEN {expand(_formula)} END", _direction, _metrics))
