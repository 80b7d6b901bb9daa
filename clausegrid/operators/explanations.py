"""What a clause's risk score is said to mean, and what the clause could say instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.texts import found
from clausegrid.operators.risk import RELEVANT, UNUSUAL

# What a score up to each bound is said to mean, and without statutes.
MEANINGS = (
    (3, ". It appears to be standard language that aligns with tenant protections."),
    (6, ". It contains some provisions worth reviewing, as they may limit your rights."),
    (8, ". It contains high-risk provisions that may significantly restrict your rights or be legally questionable."),
    (10, ". This clause is potentially unenforceable and may directly contradict Ontario tenant protection law."),
)
NO_STATUTES = " Note: No statutes were retrieved for this clause, so the risk assessment has lower confidence."
NO_STATUTES_REASON = "No statutes retrieved — risk assessment based on clause language patterns only"
ONE_SIDED = "Clause contains unusually one-sided language (e.g., absolute discretion, irrevocable waiver). Note: unusual language alone does not make a clause unenforceable."
# What a clause with a violation could say instead, by the violation.
TEMPLATES = {
    "entry_without_notice": "The Landlord may enter the rental unit only in accordance with sections 26 and 27 of the Residential Tenancies Act, 2006. The Landlord shall provide at least 24 hours' written notice specifying the reason for entry and the time of entry (between 8:00 a.m. and 8:00 p.m.). Entry without notice is permitted only in the case of an emergency as defined in s.26(3) of the Act.",
    "non_refundable_deposit": "The Tenant shall pay a last month's rent deposit equal to one month's rent, applied to the final period of the tenancy, in accordance with section 106 of the Residential Tenancies Act, 2006. This deposit is refundable and shall be returned with accrued interest if not applied to the last rent period. No other deposit or non-refundable fee may be collected.",
    "excess_deposit": "The Tenant shall provide a last month's rent deposit equal to one month's rent, as permitted by section 105 of the Residential Tenancies Act, 2006. No additional security deposit, damage deposit, pet deposit, key deposit, or other deposit of any kind may be collected beyond this one permitted amount.",
    "maintenance_offloaded": "The Landlord shall maintain the rental unit and residential complex in a good state of repair and fit for habitation, and shall comply with all applicable health, safety, housing, and maintenance standards, as required by section 20 of the Residential Tenancies Act, 2006. The Tenant is responsible for ordinary cleanliness of the rental unit only.",
    "rent_increase_without_guideline": "The Landlord may increase the rent only once per 12-month period and only in accordance with the annual rent increase guideline established by the Province of Ontario under section 120 of the Residential Tenancies Act, 2006. The Landlord shall provide at least 90 days' written notice using the prescribed Form N1 before any increase takes effect.",
    "waiver_of_rights": "Nothing in this agreement limits or modifies the rights, benefits, or protections of the Tenant under the Residential Tenancies Act, 2006. Any provision of this agreement that purports to waive or diminish those rights is void to that extent, pursuant to section 3(1) of the Act.",
    "post_dated_cheques": "Rent shall be paid on the first day of each month. Post-dated cheques and pre-authorized payment are not required. The Tenant may pay by any mutually agreed lawful method. Pre-authorized debit or cheques may be provided voluntarily but cannot be demanded as a condition of the tenancy, in accordance with section 108 of the Residential Tenancies Act, 2006.",
    "pet_fines": "Note: Any provision restricting pets is void under section 14 of the Residential Tenancies Act, 2006, and no fine, fee, or penalty may be imposed for keeping a pet, nor may a tenancy be terminated solely on the basis of having a pet.",
    "rta_waiver": "This agreement is governed by the Residential Tenancies Act, 2006. No provision of this agreement limits the rights or remedies of either party under that Act. Any term that purports to contract out of or limit the Act's protections is void, pursuant to section 3(1) of the Residential Tenancies Act, 2006.",
    "daily_late_fee": "Rent is due on the [1st] day of each month. If rent is not paid when due, the Landlord's remedy is to serve a Notice to End a Tenancy Early for Non-payment of Rent (Form N4) in accordance with section 59 of the Residential Tenancies Act, 2006. No additional charges, daily fees, interest, or penalties for late payment may be imposed.",
    "mandatory_arbitration": "Any dispute arising from this tenancy shall be resolved through the Landlord and Tenant Board in accordance with the Residential Tenancies Act, 2006. Neither party waives their right to apply to the Board. Mandatory arbitration or any clause requiring the parties to forgo LTB proceedings is void under the Act.",
    "self_help_eviction": "A tenancy may only be terminated in accordance with the Residential Tenancies Act, 2006. The Landlord shall not change the locks, seize belongings, or otherwise interfere with the Tenant's access to the rental unit. Eviction may only be carried out by a Sheriff acting on a valid order of the Landlord and Tenant Board, as required by section 19 of the Act.",
    "unlawful_termination": "Either party may terminate this tenancy only in accordance with the Residential Tenancies Act, 2006. Termination notices must be in writing on a prescribed LTB form. The Landlord shall provide at least 60 days' written notice for most terminations. Verbal notice and notice periods shorter than the statutory minimum are void and of no effect.",
    "early_termination_fee": "A tenancy may only be terminated in accordance with the Residential Tenancies Act, 2006. No lease-break fee, liquidated damages, or financial penalty may be charged for vacating before the end of a fixed term. If the Tenant wishes to end a fixed-term tenancy early, the parties may agree to a mutual termination in writing. The Landlord's remedies upon early departure are limited to those provided by the Act.",
    "surveillance_in_unit": "The Landlord shall not install or maintain any camera, recording device, or monitoring equipment inside the rental unit. Security cameras may only be installed in common areas of the residential complex (hallways, entrances, parking areas) with appropriate notice to residents. The Tenant has an exclusive right to privacy within the rental unit, in accordance with the Residential Tenancies Act, 2006 and applicable privacy legislation.",
    "guest_surcharge": "The Tenant may have guests visit the rental unit. No additional charges, fees, or surcharges may be imposed on the Tenant for the presence or duration of stay of any guest. The only remedy available to the Landlord with respect to guests who have become unauthorized occupants is through the Landlord and Tenant Board process, as permitted by the Residential Tenancies Act, 2006.",
    "assignment_fee": "The Tenant may request to assign the tenancy or sublet the rental unit in accordance with the Residential Tenancies Act, 2006. The Landlord shall not charge any fee or administrative charge for processing or consenting to such a request. If the Landlord refuses consent without reasonable grounds, the Tenant may terminate the tenancy by giving 30 days' written notice, in accordance with section 97 of the Act.",
    "vital_services_cutoff": "The Landlord shall provide and maintain the following vital services at all times during the tenancy: [heat / hot and cold water / fuel / electricity / natural gas]. The Landlord shall not cause or permit the supply of any vital service to be withheld or interrupted, in accordance with sections 29–31 of the Residential Tenancies Act, 2006. Responsibility for vital services cannot be transferred to the Tenant by agreement.",
    "quiet_enjoyment_violation": "The Landlord shall not substantially interfere with the Tenant's reasonable enjoyment of the rental unit or residential complex. Entry by the Landlord for any purpose (including inspections, repairs, or showing the unit) requires at least 24 hours' written notice specifying the reason and time of entry (between 8 a.m. and 8 p.m.), in accordance with sections 22, 26, and 27 of the Residential Tenancies Act, 2006. Periodic 'routine inspection' clauses that do not comply with the notice requirements of ss.26/27 are void.",
    "assignment_prohibition": "The Tenant may request to assign this tenancy or sublet the rental unit in accordance with the Residential Tenancies Act, 2006. Such requests require the written consent of the Landlord, which shall not be arbitrarily or unreasonably withheld. A complete prohibition on assignment or subletting with no consent pathway is void under section 95 of the Act — the Landlord may require consent but cannot outright prevent the Tenant from making a request.",
    "unlawful_renewal_obligation": "At the end of the fixed-term period, this tenancy agreement will automatically continue on a month-to-month basis on the same terms and conditions, in accordance with section 38 of the Residential Tenancies Act, 2006. Neither party is required to give notice of an intention to not renew. Either party may terminate the tenancy only through the proper notice procedures under the Act.",
    "multiple_rent_increases": "The Landlord may increase the rent no more than once per 12-month period, in accordance with section 119 of the Residential Tenancies Act, 2006. Any increase must comply with the annual rent increase guideline established under section 120 of the Act and requires at least 90 days' written notice on the prescribed Form N1. Indexing rent to CPI, inflation, or any other measure on a more frequent basis is void.",
    "service_reduction_no_rent_decrease": "If the Landlord reduces or eliminates any service or facility that is included in the rent (such as parking, storage, laundry, or utilities), the rent shall be reduced by a corresponding amount in accordance with section 125 of the Residential Tenancies Act, 2006. Either party may apply to the Landlord and Tenant Board to determine the appropriate reduction. Any clause allowing removal of included services without a rent reduction is void.",
    "retaliation_or_coercion": "The Landlord shall not take any retaliatory action — including issuing a notice of termination, increasing rent, or reducing services — because the Tenant has exercised or intends to exercise any right under the Residential Tenancies Act, 2006, including the right to apply to the Landlord and Tenant Board, request repairs, or make a complaint to any government authority, in accordance with sections 83, 139, and 3(1) of the Act.",
}


def meaning(score: Column, with_statutes: Column) -> Column:
    """A sentence on what a score means, and one more where no statutes stand behind it."""
    said = reduce(lambda out, m: F.when(score <= m[0], m[1]).otherwise(out), reversed(MEANINGS[:-1]), F.lit(MEANINGS[-1][1]))
    whole = F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))
    return F.concat(F.lit("This clause scores "), whole, F.lit("/10 risk"), said, F.when(with_statutes, "").otherwise(NO_STATUTES))


def template(violations: Column) -> Column:
    """What the clause could say instead of its first violation that has a template; null without one."""
    known = F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv))
    return F.try_element_at(F.filter(F.transform(violations, lambda v: F.try_element_at(known, v)), lambda t: t.isNotNull()), F.lit(1))


def statute_reference(s: Column) -> Column:
    """A statute (act, section, title) as it is cited; a form's section by its title only."""
    titled = F.coalesce(s["title"], F.lit("")) != ""
    form = F.when(titled, F.concat(s["act"], F.lit(" — "), s["title"])).otherwise(s["act"])
    return F.when(s["section"].startswith("form_"), form).otherwise(F.concat(s["act"], F.lit(" s."), s["section"], F.when(titled, F.concat(F.lit(" ("), s["title"], F.lit(")"))).otherwise("")))


def explained(scored: DataFrame) -> DataFrame:
    """Adds unusual, explanation, suggested and reasons to scored clauses.

    Needs text, risk_score, violations and statutes, an array of (act, section,
    title, relevance). Reasons are the violations by name, one-sided language,
    and the relevant statutes, or that there are none; without any the score alone.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    unusual = reduce(lambda a, b: a | b, (found(low, low, p) for p in UNUSUAL))
    relevant = F.filter("statutes", lambda s: s["relevance"] >= RELEVANT)
    cited = F.array_join(F.transform(relevant, statute_reference), ", ")
    names = F.array_join(F.transform("violations", lambda v: F.regexp_replace(v, "_", " ")), "; ")
    parts = F.concat_ws(
        ". ",
        F.when(F.size("violations") > 0, F.concat(F.lit("Statutory violations found: "), names)),
        F.when(F.col("unusual"), ONE_SIDED),
        F.when(F.size(relevant) > 0, F.concat(F.lit("Assessed against: "), cited)).when(F.size("statutes") == 0, NO_STATUTES_REASON),
    )
    score = F.col("risk_score").cast("int").cast("string")
    alone = F.concat(F.lit("Clause assessed on language patterns. Score: "), score, F.lit("/10."))
    rows = scored.withColumn("unusual", unusual)
    return rows.withColumns({"explanation": meaning(F.col("risk_score"), F.size("statutes") > 0), "suggested": template(F.col("violations")), "reasons": F.when(parts == "", alone).otherwise(parts)})
