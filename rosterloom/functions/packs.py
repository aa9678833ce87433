"""Term lists that rules about names, roles and mailboxes work with: a default pack, which a country's pack adds to."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Pack:
    """Lower-case terms by kind. ``role_aliases`` maps a canonical role to the terms that stand for it, in order."""

    name_particles: tuple[str, ...] = ()
    name_stopwords: tuple[str, ...] = ()
    address_terms: tuple[str, ...] = ()
    office_name_terms: tuple[str, ...] = ()
    boilerplate_name_fragments: tuple[str, ...] = ()
    office_role_terms: tuple[str, ...] = ()
    role_signal_terms: tuple[str, ...] = ()
    role_aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()
    international_markers: tuple[str, ...] = ()
    office_markers: tuple[str, ...] = ()
    admissions_markers: tuple[str, ...] = ()
    relevant_mailbox_terms: tuple[str, ...] = ()
    irrelevant_mailbox_terms: tuple[str, ...] = ()
    generic_unscoped_localparts: tuple[str, ...] = ()
    suspicious_name_phrases: tuple[str, ...] = ()
    suspicious_name_terms: tuple[str, ...] = ()
    relevant_office_role_terms: tuple[str, ...] = ()
    senior_role_terms: tuple[str, ...] = ()
    international_leadership_terms: tuple[str, ...] = ()
    person_name_titles: tuple[str, ...] = ()
    enrichment_block_phrases: tuple[str, ...] = ()
    enrichment_block_terms: tuple[str, ...] = ()

    def merged(self, other: Pack) -> Pack:
        """Both packs as one: lists are united in order, aliases of one role too."""
        out = {}
        for f in fields(self):
            mine, theirs = getattr(self, f.name), getattr(other, f.name)
            if f.name == "role_aliases":
                roles = dict(mine)
                for role, terms in theirs:
                    roles[role] = tuple(dict.fromkeys((*roles.get(role, ()), *terms)))
                out[f.name] = tuple(roles.items())
            else:
                out[f.name] = tuple(dict.fromkeys((*mine, *theirs)))
        return Pack(**out)


def _t(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


# The terms of the default pack.
DEFAULT = Pack(
    name_particles=_t("abu, al, ap, ben, bin, bint, da, das, de, del, der, des, dos, du, el, ibn, la, le, mac, mc, st, st., van, von"),
    name_stopwords=_t(
        "address, admissions, administrative, area, avenue, building, call, campus, center, centre, city, contact, contacts, department, director, directory, email, floor, global, hello, international, mail, manager,"
        " mobility, office, partnership, partnerships, phone, policy, public, relations, road, room, service, services, staff, street, student, students, support, team, title, unit, university, welcome"
    ),
    address_terms=_t("address, avenue, building, campus, city, floor, road, room, street"),
    office_name_terms=_t("administration, admissions, campus, center, centre, department, desk, division, office, policy, program, programme, school, secretariat, service, services, staff, team, unit, welcome"),
    boilerplate_name_fragments=_t("click here, contact us, email us, for more information, international office, office of, privacy policy"),
    office_role_terms=_t("admissions, center, centre, cooperation, department, engagement, erasmus, exchange, global, helpdesk, international, mobility, office, partnership, relations, secretariat, service, study abroad, team, unit, welcome"),
    role_signal_terms=_t("global engagement, international cooperation, international relations, international student, international students, mobility office, study abroad, welcome office"),
    role_aliases=(
        ("global engagement", _t("global engagement, global office, global strategy")),
        ("international admissions", _t("international admission, international admissions")),
        ("international mobility", _t("erasmus, exchange, mobility")),
        ("international partnerships", _t("cooperation, partnership, partnerships")),
        ("international relations", _t("international relations")),
        ("international student office", _t("international student, international students, welcome office")),
    ),
    international_markers=_t("global, international"),
    office_markers=_t("center, centre, department, desk, office, secretariat, service, services, team, unit, welcome"),
    admissions_markers=_t("admission, admissions"),
    relevant_mailbox_terms=_t("cooperation, engagement, erasmus, exchange, global, incoming, international, mobility, outgoing, partnership, relations, studyabroad, studyabroadoffice"),
    irrelevant_mailbox_terms=_t("housing, library, press, privacy, protocol, student, webmaster"),
    generic_unscoped_localparts=_t("contact, hello, info, office, support"),
    suspicious_name_phrases=_t("privacy policy"),
    suspicious_name_terms=_t("academy, college, institute, policy, privacy, university"),
    relevant_office_role_terms=_t("erasmus, exchange office, global engagement, international cooperation, international office, international partnerships, international relations, mobility office, study abroad, welcome office"),
    senior_role_terms=_t("administrative director, chair, chancellor, dean, director, executive director, general director, head, manager, president, provost, rector, vice chancellor, vice president, vice rector"),
    international_leadership_terms=_t(
        "coordinator, director of international, global engagement lead, head of international, head of mobility, head of partnerships, international coordinator, international delegate, international director,"
        " international lead, mobility coordinator, partnerships lead, study abroad coordinator"
    ),
    person_name_titles=_t("dr, mr, mrs, ms, prof"),
    enrichment_block_phrases=_t("european credit transfer system, inter institutional agreement, inter istitutional agreement, inter-institutional agreement, inter-istitutional agreement"),
    enrichment_block_terms=_t("agreement, credit, credits, info, institutional, istitutional, magazine, research, study, system"),
)

# Words of roles, of rank, and of international offices in other languages; marks of page furniture.
ROLE_WORDS = (
    "international|global|admissions?|recruit(?:ment|er)?|partnerships?|relations?|engagement|enrol?ment|outreach|external|mobility|exchange|worldwide|external affairs|institutional advancement|rector|chancellor|president|provost"
    "|vice[- ]?chancellor|prorector|vice[- ]?president"
)
SENIORITY = "head|director|chief|deputy|associate|assistant|manager|lead|officer|coordinator|vice|pro"
INTERNATIONAL_HINTS = "国际|招生|留学生|国際|入試|国际处|relaciones internacionales|admisiones|rekrutacja|échanges|relations internationales|internacional|mobilidade|auslands|internationale"
BOILERPLATE = _t("apply now, cookie, find a course, main menu, menu, news, privacy, search, skip to, social media, toggle navigation, webmail")
