"""What a publication's title says: generation types, administrative actions, their decisions, and whether it is in scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import documentary

# Patterns over the documentary form of a text (lower case, single spaces).
GENERATION_TYPES = {
    "eolica": r"\be[oó]lic|aerogenerador|parque\s+e[oó]lico",
    "fotovoltaica": r"fotovolta|\bplanta\s+solar\b|\bpsfv\b|\bfv\b",
    "termosolar": r"termosolar|solar\s+termoel[eé]ctr",
    "hidroelectrica": r"hidroel[eé]ctr|central\s+hidr[aá]ul",
    "biomasa": r"biomasa",
    "biogas": r"biog[aá]s",
    "geotermica": r"geot[eé]rm",
}
ACTIONS = {
    "correccion_errores": r"(?:correcci[oó]n|rectificaci[oó]n)(?:\s+de)?\s+errores?",
    "autorizacion_administrativa_previa": r"autorizaci[oó]n\s+administrativa\s+previa|\baap\b",
    "autorizacion_administrativa_construccion": r"autorizaci[oó]n\s+administrativa\s+(?:de\s+)?construcci[oó]n|autorizaci[oó]n\s+(?:de\s+)?construcci[oó]n|autoriza[^.;]{0,50}construcci[oó]n|\baac\b",
    "autorizacion_explotacion": r"autorizaci[oó]n\s+(?:de\s+)?explotaci[oó]n",
    "concesion_aguas": r"(?:otorga|concede|solicitud\s+de)\s+(?:la\s+)?concesi[oó]n|concesi[oó]n\s+para\s+el\s+aprovechamiento",
    "declaracion_utilidad_publica": r"(?:declaraci[oó]n|reconocimiento)(?:\s*,\s*|\s+)(?:en\s+concreto(?:\s*,\s*|\s+))?de\s+utilidad\s+p[uú]blica|\bdup\b",
    "declaracion_impacto_ambiental": r"declaraci[oó]n\s+de\s+impacto\s+ambiental|\bdia\b",
    "informe_impacto_ambiental": r"informe\s+de\s+impacto\s+ambiental",
    "informe_determinacion_afeccion_ambiental": r"informe\s+de\s+determinaci[oó]n\s+de\s+afecci[oó]n\s+ambiental|\bidaa\b",
    "levantamiento_actas_previas_ocupacion": r"levantamiento\s+de\s+actas\s+previas\s+a\s+la\s+ocupaci[oó]n",
    "actas_ocupacion": r"actas\s+de\s+ocupaci[oó]n",
    "relacion_bienes_derechos_afectados": r"relaci[oó]n(?:\s+concreta\s+e\s+individualizada)?\s+de\s+bienes\s+y\s+derechos\s+afectados",
    "cambio_titularidad": r"cambio\s+de\s+titularidad|transmisi[oó]n\s+de\s+titularidad",
    "prorroga": r"pr[oó]rroga",
    "terminacion_procedimiento": r"archivo|desistimiento|inadmisi[oó]n",
}
TERMINATION = r"\b(?:desistimiento|archivo|inadmisi[oó]n)\b"
TERMINATION_OBJECT = r"(?:\bde\s+(?:la\s+|las\s+)?solicitud(?:es)?\s+de\s+|\bdel\s+(?:expediente|procedimiento)\s+de\s+|,\s*de\s+|\bde\s+)$"
INDEPENDENT_ACTION = r"(?:[,;]\s*)?(?:y\s+)?se\s+(?:otorga|concede|autoriza|deniega|somete|formula|aprueba|declara)\b"
PUBLIC_INFORMATION = r"(?:somete|sometimiento|anuncio)[^.;]{0,180}informaci[oó]n\s+p[uú]blica"
ENVIRONMENTAL_PROCESS = r"estudio\s+de\s+impacto\s+ambiental|evaluaci[oó]n\s+de\s+impacto\s+ambiental"
ENVIRONMENTAL_PRODUCTS = ("declaracion_impacto_ambiental", "informe_impacto_ambiental", "informe_determinacion_afeccion_ambiental")
GRANTED = r"\b(?:otorga(?:n|r|d[ao]s?)?|concede(?:n|r)?|concedid[ao]s?|autoriza(?:n|r|d[ao]s?)?)\b"
DISMISSED = r"\bdesestim(?:a(?:n)?|ar|ad[ao]s?|aci[oó]n(?:es)?)\b[^.;]{0,160}\b(?:solicitud(?:es)?|procedimiento)\b|\b(?:solicitud(?:es)?|procedimiento)\b[^.;]{0,160}\bdesestim(?:a(?:n)?|ar|ad[ao]s?|aci[oó]n(?:es)?)\b"
PROCUREMENT = r"formalizaci[oó]n\s+de\s+contratos?|anuncio\s+de\s+(?:licitaci[oó]n|adjudicaci[oó]n)|contrataci[oó]n\s+del?\s+(?:suministro|servicio|obra)|contrato\s+de\s+suministro"
OTHER_SECTOR = (
    r"abastecimiento\s+de\s+agua|mejora\s+del\s+abastecimiento|estaci[oó]n\s+depuradora|\bedar\b|saneamiento|depuraci[oó]n\s+de\s+aguas|"
    r"modernizaci[oó]n\s+de\s+regad[ií]os?|comunidad\s+de\s+regantes|equipos?\s+de\s+bombeo|obras?\s+de\s+regad[ií]o|"
    r"proyecto\s+de\s+construcci[oó]n\s+de\s+(?:carretera|ferrocarril)|vertederos?\s+asociados?\s+al\s+proyecto\s+de\s+construcci[oó]n"
)
EXPLICIT_GENERATION = (
    r"(?:planta|parque|central|instalaci[oó]n|m[oó]dulo\s+de\s+generaci[oó]n)[^.;]{0,180}(?:fotovolta|solar|e[oó]lic|hidroel[eé]ct|termosolar|biomasa|biog[aá]s|generaci[oó]n\s+de\s+energ[ií]a\s+el[eé]ctrica)|"
    r"(?:fotovolta|e[oó]lic|hidroel[eé]ct|termosolar)[^.;]{0,100}(?:planta|parque|central|instalaci[oó]n)|"
    r"(?:aprovechamiento|central)[^.;]{0,100}producci[oó]n\s+de\s+energ[ií]a\s+el[eé]ctrica|\b(?:psfv|pfv|fv|pe)\s+[a-záéíóúñ][\wáéíóúüñ'-]+"
)
GAS = r"\bgasoductos?\b|instalaciones?\s+gasistas?|estaci[oó]n\s+(?:de\s+)?(?:medida|regulaci[oó]n|compresi[oó]n)|posici[oó]n\s+[a-z0-9.-]+[^.;]{0,120}(?:gas|biometano)|inyecci[oó]n\s+de\s+(?:biometano|hidr[oó]geno)[^.;]{0,120}(?:gasoducto|red\s+gasista|red\s+de\s+gas)"
STORAGE = r"(?:planta|sistema|instalaci[oó]n|m[oó]dulo)\s+de\s+almacenamiento(?:\s+de\s+energ[ií]a)?|\b(?:bess|sistema\s+de\s+bater[ií]as)\b"
STORAGE_LINKED = (
    r"hibridaci[oó]n|hibridad[oa]|hibrida\s+con|(?:asociad[oa]|vinculad[oa]|integrado|incorporado)\s+(?:a|al|en)\s+(?:la\s+|el\s+)?(?:planta|parque|central|instalaci[oó]n)[^.;]{0,160}(?:fotovolta|solar|e[oó]lic|hidroel[eé]ct|termosolar|biomasa|biog[aá]s)|"
    r"(?:planta|parque|central|instalaci[oó]n)[^.;]{0,160}(?:fotovolta|e[oó]lic|hidroel[eé]ct|termosolar|biomasa|biog[aá]s)"
)
HYDRO = r"hidroel[eé]ct|producci[oó]n\s+de\s+energ[ií]a\s+el[eé]ctrica|(?:central(?:es)?|generaci[oó]n)\s+hidr[aá]ulic"
WATER_AUTHORITY = r"confederaci[oó]n\s+hidrogr[aá]fica|comisar[ií]a\s+de\s+aguas"
TRANSPORT_AUTHORITY = r"demarcaci[oó]n\s+de\s+carreteras|administrador\s+de\s+infraestructuras\s+ferroviarias|\badif\b|demarcaci[oó]n\s+de\s+costas|servicio\s+provincial\s+de\s+costas|autoridad\s+portuaria|puertos\s+del\s+estado"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def has(key: Column, pattern: str) -> Column:
    """Whether the pattern is found, with letters and borders of words as in Unicode."""
    return key.rlike(f"(?U){pattern}")


def _named(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def generation_type(text: Column) -> Column:
    """The one type whose pattern is found; null if none or several are."""
    found = _named({name: has(documentary(text), p) for name, p in GENERATION_TYPES.items()})
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def _terminated(key: Column) -> Column:
    """Actions that the title names only as the object of a termination.

    The object begins with the first action after the termination, if the words
    between lead to one, and ends where the title goes on with an action of its own.
    """
    others = {name: p for name, p in ACTIONS.items() if name != "terminacion_procedimiento"}
    every = "|".join(f"(?:{p})" for p in others.values())
    rest = F.regexp_replace(key, rf"(?U)^.*?{TERMINATION}", "")
    start = F.regexp_instr(rest, F.lit(f"(?U){every}"))
    intro = F.substr(rest, F.lit(1), start - 1)
    object_ = F.substr(rest, start)
    first = F.regexp_extract(object_, f"(?U)^(?:{every})", 0)
    tail = F.substr(object_, F.length(first) + 1)
    own = F.concat(first, F.regexp_replace(tail, rf"(?U){INDEPENDENT_ACTION}.*$", ""))
    outside = F.concat(F.substr(key, F.lit(1), F.length(key) - F.length(rest)), F.lit(" ; "), F.substr(object_, F.length(own) + 1))
    applies = has(key, TERMINATION) & (start > 0) & has(intro, TERMINATION_OBJECT)
    named = _named({name: has(own, p) & ~has(outside, p) for name, p in others.items()})
    return F.when(applies, named).otherwise(F.array().cast("array<string>"))


def title_actions(title: Column) -> Column:
    """Sorted actions of a title. A correction of errors is alone; public information of an environmental procedure is its assessment."""
    key = documentary(title)
    found = _named({name: has(key, p) for name, p in ACTIONS.items()})
    current = F.array_except(found, _terminated(key))
    products = F.array(*[F.lit(p) for p in ENVIRONMENTAL_PRODUCTS])
    environmental = F.arrays_overlap(current, products) | has(key, ENVIRONMENTAL_PROCESS)
    public = F.when(environmental, F.array_append(F.array_except(current, products), "evaluacion_impacto_ambiental")).when(F.size(current) == 0, F.array(F.lit("informacion_publica"))).otherwise(current)
    told = F.when(has(key, PUBLIC_INFORMATION), public).otherwise(current)
    return F.array_sort(F.when(F.array_contains(found, "correccion_errores"), F.array(F.lit("correccion_errores"))).otherwise(told))


def title_decision(title: Column, action: Column) -> Column:
    """The decision on an action, from the first rule that holds."""
    key = documentary(title)
    public = has(key, r"informaci[oó]n\s+p[uú]blica")
    authorization = action.isin("autorizacion_administrativa_previa", "autorizacion_administrativa_construccion", "autorizacion_explotacion", "cambio_titularidad")
    water, utility, end = action == "concesion_aguas", action == "declaracion_utilidad_publica", action == "terminacion_procedimiento"
    asked = has(key, r"solicitud|solicita")
    rules = [
        (action == "correccion_errores", "rectificado"),
        (public, "sometido_informacion_publica"),
        (action.isin(*ENVIRONMENTAL_PRODUCTS) & has(key, r"desfavorable|no\s+favorable"), "desfavorable"),
        (action.isin(*ENVIRONMENTAL_PRODUCTS) & has(key, "favorable"), "favorable"),
        (action.isin(*ENVIRONMENTAL_PRODUCTS), "formulado"),
        ((action == "autorizacion_administrativa_previa") & has(key, DISMISSED), "desestimado"),
        (authorization & has(key, r"\b(?:deniega|denegaci[oó]n)\b"), "denegado"),
        (authorization & has(key, GRANTED), "autorizado"),
        (authorization & has(key, r"\b(?:solicitud|solicita)\b"), "solicitado"),
        (authorization, "autorizado"),
        (water & has(key, r"deniega|denegaci[oó]n"), "denegado"),
        (water & asked & ~has(key, "otorga|concede"), "solicitado"),
        (water, "autorizado"),
        (utility & has(key, "solicitud"), "sometido_informacion_publica"),
        (utility, "declarado"),
        (action.isin("levantamiento_actas_previas_ocupacion", "actas_ocupacion", "relacion_bienes_derechos_afectados"), "convocado"),
        (action == "prorroga", "prorrogado"),
        (end & has(key, "desist"), "desistido"),
        (end & has(key, "inadmis"), "inadmitido"),
        (end, "archivado"),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit("otro"))


def scope_guard(title: Column) -> Column:
    """decision and rule: whether a title alone settles that a document is in or out of scope."""
    key = documentary(title)
    explicit, hydro = has(key, EXPLICIT_GENERATION), has(key, HYDRO)
    electric = explicit | hydro
    rules = [
        (has(key, PROCUREMENT), "procurement"),
        (has(key, GAS) & ~explicit, "gas_infrastructure"),
        (has(key, STORAGE) & ~has(key, STORAGE_LINKED) & ~explicit, "standalone_storage"),
        (has(key, OTHER_SECTOR) & ~electric, "other_sector"),
        (has(key, WATER_AUTHORITY) & ~electric, "water_authority"),
        (has(key, TRANSPORT_AUTHORITY) & ~electric, "transport_or_coastal"),
    ]
    rule = reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    review = explicit & (F.size(title_actions(title)) > 0)
    decision = F.when(rule.isNotNull(), "force_not_relevant").when(review, "require_project_review").otherwise("no_deterministic_decision")
    return F.struct(decision.alias("decision"), F.coalesce(rule, F.when(review, "generation_and_action")).alias("rule"))


def dates(text: Column) -> Column:
    """Sorted distinct valid dates: ``5 de marzo de 2024``, ``5/3/2024`` and ``5-3-2024``."""
    long = rf"(?iU)\b([0-3]?\d)\s+de\s+({'|'.join(MONTHS)})\s+de\s+((?:19|20)\d{{2}})\b"
    short = r"(?U)\b([0-3]?\d)[/-]([01]?\d)[/-]((?:19|20)\d{2})\b"
    value = F.coalesce(text, F.lit(""))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    one = lambda p, i: F.regexp_extract_all(value, F.lit(p), F.lit(i))
    named = F.zip_with(F.zip_with(one(long, 3), F.transform(one(long, 2), lambda m: months[F.lower(m)]), lambda y, m: F.concat_ws("-", y, m)), one(long, 1), lambda a, d: F.concat_ws("-", a, d))
    plain = F.zip_with(F.zip_with(one(short, 3), one(short, 2), lambda y, m: F.concat_ws("-", y, m)), one(short, 1), lambda a, d: F.concat_ws("-", a, d))
    parsed = F.transform(F.concat(named, plain), lambda d: F.try_to_timestamp(d, F.lit("y-M-d")).cast("date"))
    return F.array_sort(F.array_distinct(F.array_compact(parsed)))


def has_earlier_date(text: Column, day: Column) -> Column:
    return F.exists(dates(text), lambda d: d < day)
