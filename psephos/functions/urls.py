"""Web addresses of sources, their publishers and their quality."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.functions.nulls import clean_text, truthy

#: Query parameters that only track visitors; fixed values.
TRACKING = ("utm_", "fbclid=", "gclid=")
#: Publishers by domain; fixed values.
PUBLISHERS = {
    "wikipedia.org": "Wikipedia", "wikimedia.org": "Wikimedia", "data.ipu.org": "Inter-Parliamentary Union (IPU)", "idi.org.il": "Israel Democracy Institute",
    "parlgov.fly.dev": "ParlGov", "boe.es": "Boletín Oficial del Estado (BOE)", "rtve.es": "RTVE", "eitb.eus": "EITB", "europapress.es": "Europa Press",
    "congress.gov": "Congress.gov", "juntaelectoralcentral.es": "Junta Electoral Central", "infoelectoral.interior.gob.es": "Ministerio del Interior (España)",
    "electionguide.org": "IFES Election Guide", "manifesto-project.wzb.eu": "Manifesto Project", "robert-schuman.eu": "Fondation Robert Schuman",
    "odihr.osce.org": "OSCE/ODIHR", "osce.org": "OSCE", "gov.il": "Gov.il",
}
#: Domains and words of each class of source; fixed values.
ENCYCLOPEDIA = ("wikipedia.org", "wikimedia.org")
ENCYCLOPEDIA_WORDS = ("wikipedia", "wikimedia")
INTERGOVERNMENTAL = ("data.ipu.org", "ipu.org", "archive.ipu.org", "osce.org", "odihr.osce.org", "oscepa.org", "coe.int")
INTERGOVERNMENTAL_WORDS = (
    "inter-parliamentary union", "osce/odihr", "organization for security and co-operation in europe", "organization for security and cooperation in europe",
    "office for democratic institutions and human rights", "odihr", "council of europe", "ipu parline", "parline",
)
INSTITUTIONAL = (
    "idi.org.il", "parlgov.fly.dev", "parlgov", "idea.int", "ifes.org", "electionguide.org", "israeled.org", "crsreports.congress.gov", "constitutionnet.org",
    "parline.org", "parties-and-elections.eu", "manifesto-project.wzb.eu", "wzb.eu", "robert-schuman.eu",
)
INSTITUTIONAL_WORDS = (
    "israel democracy institute", "parlgov", "manifesto project", "ifes election guide", "election guide", "international institute for democracy",
    "fondation robert schuman", "manifesto project dataset",
)
NEWS_PARTS = (
    "reuters.com", "apnews.com", "bbc.", "dw.com", "elpais.com", "rtve.es", "eitb.eus", "europapress.es", "theguardian.com", "nytimes.com", "timesofisrael.com",
    "jpost.com", "axios.com", "sputnikportal.", "sputniknews.", "lemonde.fr", "politico.eu",
)
PUBLIC = (
    "juntaelectoralcentral.es", "infoelectoral.interior.gob.es", "boe.es", "congress.gov", "gov.il", "knesset.gov.il", "main.knesset.gov.il", "bechirot.gov.il",
    "bechirot24.bechirot.gov.il", "senato.it", "camera.it", "kiesraad.nl", "english.kiesraad.nl", "dekamer.be", "ch.ch", "ge.ch", "bk.admin.ch",
    "swissstats.bfs.admin.ch", "bfs.admin.ch", "aboutswitzerland.eda.admin.ch", "eda.admin.ch", "arhiva.rik.parlament.gov.rs",
)
PUBLIC_SUFFIXES = ("admin.ch", "gov.il", "gov.rs", "parlament.gov.rs", "knesset.gov.il", "bechirot.gov.il")
PUBLIC_PARTS = (
    ".gov", "gov.", ".gob", "gob.", "europa.eu", "europarl", "interior.gob", "juntaelectoralcentral", "electoralcommission", "electoral-commission",
    "electionresults", "parliament.uk", "senato.it", "camera.it", "kiesraad.nl", "dekamer.be", ".admin.ch",
)
PUBLIC_PUBLISHER_WORDS = (
    "electoral commission", "election commission", "official election results", "official results", "junta electoral central", "ministry of interior",
    "ministerio del interior", "central election commission", "boletín oficial del estado", "boletin oficial del estado", "senato della repubblica",
    "camera dei deputati", "kiesraad", "chamber of representatives", "house of representatives", "federal public service interior", "federal public service",
    "federal chancellery", "schweizerische bundeskanzlei", "federal statistical office", "department of foreign affairs",
    "foreign affairs (about switzerland)", "swiss confederation", "république et canton", "republique et canton", "canton de genève", "canton de geneve",
    "belgian chamber of representatives",
)
PUBLIC_TITLE_WORDS = (
    "official election results", "official results", "the 24th knesset elections", "members of the twenty-fourth knesset", "how the national council is elected",
    "nationalratswahlen", "election du conseil national", "elections to the house of representatives", "source : service public fédéral intérieur",
    "source : service public federal interieur",
)
PARTY_WORDS = ("official party page", "official party website", "official page", "official website", "party website", "party page")
PARTY_KINDS = ("party", "partido", "movement", "coalition", "list")
SCORES = {
    "encyclopedia": 45, "intergovernmental_reference": 96, "institutional_reference": 88, "news_media": 66, "official_public_source": 100, "official_party_source": 76,
}
HIGH_GRADE = ("official_public_source", "intergovernmental_reference", "institutional_reference")
INDEPENDENT = (*HIGH_GRADE, "news_media")


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, authority, path and query of an address as text."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    return tuple(F.regexp_extract(url, pattern, k) for k in (1, 2, 3, 4))


def domain_of(url: Column | str) -> Column:
    """The authority in lower case, without 'www.'."""
    return F.replace(F.lower(_parts(clean_text(url))[1]), F.lit("www."), F.lit(""))


def normalize_url(url: Column | str) -> Column:
    """Scheme (https if none), lower-case authority without 'www.', single slashes, no trailing one, no tracking, no fragment."""
    return normal_address(clean_text(url))


def normal_address(text: Column) -> Column:
    """:func:`normalize_url` of a clean text."""
    scheme, host, path, query = _parts(text)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~reduce(lambda a, b: a | b, (F.lower(p).startswith(t) for t in TRACKING))), "&")
    out = F.concat(
        F.coalesce(F.nullif(F.lower(scheme), F.lit("")), F.lit("https")), F.lit("://"), F.replace(F.lower(host), F.lit("www."), F.lit("")),
        F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )
    return F.when(text == "", "").otherwise(out)


def source_key(url: Column | str, title: Column | str) -> Column:
    """What two records of one source have in common."""
    return key_of(normalize_url(url), F.lower(clean_text(title)))


def key_of(u: Column, t: Column) -> Column:
    """The key of a normalised address and a clean title in lower case."""
    return F.when(u != "", F.concat(F.lit("url::"), u)).when(t != "", F.concat(F.lit("title::"), t)).otherwise("")


def domain_in(domain: Column, names: tuple[str, ...]) -> Column:
    """Whether the domain is one of the names or lies under one."""
    return domain.rlike(rf"(?:^|\.)(?:{'|'.join(map(re.escape, names))})$")


def publisher_of(domain: Column | str) -> Column:
    return publisher_named(bare_domain(domain))


def bare_domain(domain: Column | str) -> Column:
    return F.replace(F.lower(clean_text(domain)), F.lit("www."), F.lit(""))


def publisher_named(d: Column) -> Column:
    """:func:`publisher_of` of a bare domain."""
    out = d
    for name in reversed(PUBLISHERS):
        out = F.when(domain_in(d, (name,)), PUBLISHERS[name]).otherwise(out)
    return out


def _holds(x: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text holds one of the parts, each searched for by bytes: an alternation is tried at every place of the text."""
    return truthy(reduce(lambda a, b: a | b, (x.contains(part) for part in parts)))


def source_quality(domain: Column | str, publisher: Column | str, title: Column | str, why: Column | str) -> Column:
    """struct(tag, score) of a source; the first class that fits."""
    p, t, w = (F.lower(clean_text(x)) for x in (publisher, title, why))
    return quality_of(bare_domain(domain), p, t, w, F.concat_ws(" | ", p, t, w))


def quality_of(d: Column, p: Column, t: Column, w: Column, text: Column) -> Column:
    """:func:`source_quality` of a bare domain, of clean texts in lower case, and of these joined."""
    public = domain_in(d, PUBLIC) | domain_in(d, PUBLIC_SUFFIXES) | _holds(d, PUBLIC_PARTS) | ((d == "") & (_holds(text, PUBLIC_PUBLISHER_WORDS) | _holds(text, PUBLIC_TITLE_WORDS)))
    party = _holds(text, PARTY_WORDS) | (text.contains("official") & _holds(text, PARTY_KINDS))
    classes = (
        ("encyclopedia", domain_in(d, ENCYCLOPEDIA) | ((d == "") & _holds(p, ENCYCLOPEDIA_WORDS))),
        ("intergovernmental_reference", domain_in(d, INTERGOVERNMENTAL) | _holds(text, INTERGOVERNMENTAL_WORDS)),
        ("institutional_reference", domain_in(d, INSTITUTIONAL) | _holds(text, INSTITUTIONAL_WORDS)),
        ("news_media", _holds(d, NEWS_PARTS)), ("official_public_source", public), ("official_party_source", party),
    )
    verdict = _verdict("other_web", F.when((p != "") | (t != "") | (w != ""), 55).otherwise(40))
    for name, cond in reversed(classes):  # tag and score together, so that no condition is tried for each
        verdict = F.when(cond, _verdict(name, F.lit(SCORES[name]))).otherwise(verdict)
    return verdict


def _verdict(tag: str, score: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), score.alias("score"))
