"""SQL that gives the same rows as queries of this subpackage, for those that SQL can express."""

from __future__ import annotations

from rosterloom.llm.textnorm import STAND_INS


def _clean(col: str) -> str:
    return f"regexp_replace(lower({col}), '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')"


_LEVELS = f"""
  select ranked_id, institution_id, {_clean('email')} mailbox,
    case {_clean('confidence')} when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end conf,
    case {_clean('email_source')} when 'direct' then 3 when 'same_domain_page' then 2 when 'role_holder_page' then 2 when 'email_pattern' then 1 when 'inferred' then 1 else 0 end src,
    case when title is null or {_clean('title')} in ({", ".join("'" + x.replace("'", "''") + "'" for x in sorted(STAND_INS))}) then 0 else 1 end title,
    case when regexp_matches({_clean('evidence_url')}, '^https?://[^\\s/]+\\.[^\\s]+') then 1 else 0 end evid, observed_at
  from ranked_contacts where institution_id is not null and {_clean('email')} <> ''"""

P1_FOUND = f"""
with r as ({_LEVELS}),
g as (select institution_id, mailbox, count(*) n, max(conf) c, max(src) s, max(title) t, max(evid) e, max(observed_at) o from r group by all)
select min(ranked_id) ranked_id from r join g using (institution_id, mailbox)
where n > 1 and conf = c and src = s and title = t and evid = e and observed_at = o group by institution_id, mailbox
"""

#: Every combination of whole bundles of a branch, by brute force: provenance x identity x recency under the dependency
#: on the name, the best by trust, then fewest records, then smallest ids; then the best branch of the group.
P1_SURVIVORS = f"""
with r as (
  select l.*, case when o.name is null or {_clean('o.name')} in ({", ".join("'" + x.replace("'", "''") + "'" for x in sorted(STAND_INS))}) then '' else regexp_replace({_clean('o.name')}, '[\\s\\p{{Z}}\\p{{P}}]+', ' ', 'g') end who,
    coalesce(epoch_us(o.observed_at), -4611686018427387904) seen
  from ({_LEVELS}) l join ranked_contacts o using (ranked_id) where l.mailbox <> ''),
sized as (select institution_id, mailbox, count(*) records from r group by all),
cell as (select * from r qualify row_number() over (partition by institution_id, mailbox, who, conf, src, evid, title order by seen desc, ranked_id) = 1),
branch as (select institution_id, mailbox, who, count(*) n from r group by all),
member as (
  select b.institution_id, b.mailbox, b.who branch, b.n, c.ranked_id, c.who, c.conf, c.src, c.evid, c.title, c.seen, max(c.seen) over (partition by b.institution_id, b.mailbox, b.who) latest
  from branch b join cell c on b.institution_id = c.institution_id and b.mailbox = c.mailbox and (c.who = b.who or c.who = '')),
combo as (
  select p.institution_id, p.mailbox, p.branch, p.n, p.ranked_id provenance_id, i.ranked_id identity_id, q.ranked_id recency_id,
    4.0 * p.conf + 3.0 * p.src + 2.0 * p.evid + 3.0 * i.title + 0.5 * (i.who <> '')::int + 1.0 * (q.seen = q.latest)::int trust,
    len(list_distinct([p.ranked_id, i.ranked_id, q.ranked_id])) ids
  from member p join member i using (institution_id, mailbox, branch) join member q using (institution_id, mailbox, branch)
  where i.who = '' or p.who = '' or p.who = i.who),
best as (select * from combo qualify row_number() over (partition by institution_id, mailbox, branch order by trust desc, ids, provenance_id, identity_id, recency_id) = 1),
top as (select * from best qualify row_number() over (partition by institution_id, mailbox order by trust desc, n desc, identity_id) = 1),
g as (select institution_id, mailbox, max(conf) c, max(src) s, max(title) t, max(evid) e, max(seen) o from r group by all),
dom as (select institution_id, mailbox, min(ranked_id) dominant_id from r join g using (institution_id, mailbox) where conf = c and src = s and title = t and evid = e and seen = o group by all)
select institution_id, mailbox, records, i.name "name", i.title "title", p.confidence confidence, p.email_source email_source, p.evidence_url evidence_url, p.evidence_type evidence_type, p.source_url source_url,
  epoch_us(q.observed_at) observed_at, q.candidate_status candidate_status, provenance_id, identity_id, recency_id, trust::double trust, dominant_id
from top join sized using (institution_id, mailbox) left join dom using (institution_id, mailbox)
join ranked_contacts p on p.ranked_id = provenance_id join ranked_contacts i on i.ranked_id = identity_id join ranked_contacts q on q.ranked_id = recency_id
"""

_FORM = "regexp_replace(lower(nfc_normalize(coalesce({c}, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{So}}]+', '', 'g')"
_BARE = "regexp_replace(lower(nfc_normalize(coalesce(name, ''))), '[\\p{Cf}''’‘`´]+', '', 'g')"
_PARTS = f"array_to_string(list_sort(regexp_split_to_array({_BARE}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{So}}]+')), '')"
_KEYED = f"select contact_id, {_PARTS} k1, {_FORM.format(c='email')} k2, {_FORM.format(c='page_url')} k3 from contacts"

P5_FOUND = f"""
with k as ({_KEYED}), g as (select k1, k2, k3, min(contact_id) first_id from k group by all having count(*) > 1)
select first_id, contact_id copy_id from k join g using (k1, k2, k3) where contact_id <> first_id
"""

P5_COLLAPSED = f"with k as ({_KEYED}) select min(contact_id) first_id, count(*) copies from k group by k1, k2, k3"

_WORDS = "string_split(trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), '[\\p{{Cf}}''’‘`´]+', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{So}}]+', ' ', 'g'), ' '), ' ')"
_GRAMS = "select distinct {k}, array_to_string(w[p:p + 11], ' ') g from (select {k}, w, unnest(range(1, len(w) - 10)) p from (select {k}, {w} w from {t}) where len(w) >= 12)"

P9_FOUND = f"""
with d as ({_GRAMS.format(k='doc_id', t='documents', w=_WORDS.format(c='"text"'))}), i as ({_GRAMS.format(k='item_id', t='eval_items', w=_WORDS.format(c='item_text'))})
select distinct doc_id, item_id from d join i using (g)
"""

#: Forms counted by their text, not by a hash: as many as there are hashes, if none collide.
P5_CHECK = f"with k as ({_KEYED}) select count(*) records, count(distinct (k1, k2, k3)) forms, 0 collisions from k"

SQL = {"p1_survivors": P1_SURVIVORS, "p5_check": P5_CHECK, "p9_found": P9_FOUND, "p1_found": P1_FOUND, "p5_found": P5_FOUND, "p5_collapsed": P5_COLLAPSED}
