"""Best-first crawls replayed over page snapshots and recorded decisions.

A crawl is a priority queue worked off one page at a time, so it is sequential by nature; many crawls run side by side,
in rounds. Between rounds a crawl is a small row: its request, queue and replies, and the addresses it waits for. A
round joins those with the snapshots by normal form, gives each crawl the first page that there is, and lets it go on
until it needs another; so only pages that are visited or verified move, however many a host has. The outcome is an
ordered table of events; results and the visit log are projections of it.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.dates import is_stale
from pagelens.functions.html import rank_by_zone, read_page
from pagelens.functions.modeltext import parse_reply, rescue
from pagelens.functions.urls import host_of, host_suffixes, in_domains, is_document, normalize, start_domain
from pagelens.operators import candidates as facts
from pagelens.operators import gates, goals, ranking, robots, verify
from pagelens.operators.pages import CHALLENGE_CHARS, CHALLENGE_MARKERS, CHALLENGE_STATUSES
from pagelens.sources.shared import save

TOP_LINKS = 30
#: Types of events; the last is told by plug-ins that decide without a reply.
EVENT_TYPES = (
    "crawl_started", "goal_preprocessed", "page_fetched", "links_ranked", "candidates_extracted", "model_evaluating", "model_decision", "result_found", "destination_verification_failed",
    "page_skipped", "budget_exhausted", "crawl_complete", "model_skipped",
)
#: timestamp is the crawl's own clock: the request's day and the time its fetches took.
EVENT_SCHEMA = "crawl_id string, seq int, type string, timestamp string, url string, payload string"
#: Events and, with no type, what a crawl is between two rounds: its state and the addresses it waits for, best first.
ROUND_SCHEMA = EVENT_SCHEMA + ", state binary, wanted array<struct<norm_url:string,url:string>>"
#: Addresses that a crawl asks for at once; those without a snapshot are passed over in one round.
ASK_AHEAD = 16


@dataclass(frozen=True)
class Request:
    crawl_id: str
    start_url: str
    goal: str
    navigation_hint: str | None = None
    max_pages: int = 20
    max_depth: int = 5
    max_results: int | None = 1
    confidence_threshold: float = 0.70
    allowed_domains: tuple[str, ...] | None = None
    total_timeout: float | None = None
    today: date | None = None
    verification: str = "relevance"
    verify_threshold: float = verify.THRESHOLD
    follow_linked_resources: bool = False
    return_content: bool = False
    render_js: bool = False

    def __post_init__(self) -> None:
        if normalize(self.start_url) is None:
            raise ValueError(f"start_url is not a URL: {self.start_url!r}")
        if not self.goal.strip() or self.max_pages < 1 or self.max_depth < 0 or not 0 <= self.confidence_threshold <= 1 or (self.max_results is not None and self.max_results < 1):
            raise ValueError(f"crawl {self.crawl_id}: goal or limits out of range")

    @property
    def domains(self) -> frozenset[str]:
        return frozenset(self.allowed_domains or (start_domain(self.start_url),))


@dataclass
class State:
    """All that a crawl carries from page to page."""

    queue: list[tuple[float, int, str, int]] = field(default_factory=list)
    serial: int = 0
    visited: set[str] = field(default_factory=set)
    found: list[dict] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)
    verified: list[dict] = field(default_factory=list)
    pages: int = 0
    depth: int = 0
    sent_to_verify: int = 0
    best_url: str | None = None
    best_confidence: float = 0.0
    depth_limit_met: bool = False
    out_of_time: bool = False
    refused: bool = False
    clock_ms: int = 0

    def push(self, url: str, score: float, depth: int) -> None:
        heapq.heappush(self.queue, (-score, self.serial, url, depth))
        self.serial += 1

    def has_work(self) -> bool:
        return any(norm is not None and norm not in self.visited for norm in (normalize(item[2]) for item in self.queue))


class Skipped(Exception):
    """A page is left; carries the kind of error, if it is one."""

    def __init__(self, reason: str, kind: str | None = None):
        super().__init__(reason)
        self.kind = kind


class Wanted(Exception):
    """A snapshot that a crawl needs to go on is not at hand."""

    def __init__(self, norm: str, url: str):
        super().__init__(norm)
        self.norm, self.url = norm, url


Event = tuple[str, str | None, dict]


class Crawl:
    """One crawl: ``run`` yields (type, url, payload) in order.

    Preprocessor, ranker, extractor, verifier and the robots test are plug-ins, callables with the defaults' signatures.
    An extractor that fails finds nothing, a verifier that fails rejects, a ranker that fails skips the page; the crawl
    goes on.
    """

    def __init__(
        self, request: Request, snapshots: dict[str, dict], replies: dict[str, list[Any]], *, goal: goals.Goal | None = None, blocked: Callable[[str], str | None] = lambda url: None,
        ranker: Callable = ranking.rank_page, extractor: Callable | None = None, verifier: Callable = verify.check_one,
    ):
        self.request, self.snapshots, self.blocked = request, snapshots, blocked
        self.ranker, self.extractor, self.verifier = ranker, extractor or self.facts, verifier
        self.replies = {k: list(v) for k, v in replies.items()}
        self.goal = goal or goals.preprocess(request.goal, request.navigation_hint, today=request.today or date(1970, 1, 1))
        self.state = State()

    # what stands for the network and the model

    def look(self, norm: str, url: str) -> dict | None:
        """The snapshot of an address, if there is one."""
        return self.snapshots.get(norm)

    def fetch(self, norm: str, url: str) -> dict:
        page = self.look(norm, url)
        if page is None:
            raise Skipped("no snapshot", "NetworkError")
        if page.get("error"):
            raise Skipped(str(page["error"]), str(page["error"]))
        head = (page.get("html") or "")[:CHALLENGE_CHARS].lower()
        if page["status"] in CHALLENGE_STATUSES and any(m in head for m in CHALLENGE_MARKERS):
            raise Skipped("bot challenge", "ChallengeError")
        self.state.clock_ms += int(page.get("fetch_ms") or 0)
        return page

    def decide(self, norm: str, page_url: str) -> gates.Decision:
        """The next recorded reply that passes the schema, of two."""
        said = "no reply recorded"
        for _ in range(2):
            left = self.replies.get(norm)
            if not left:
                break
            raw = left.pop(0)
            try:
                reply = parse_reply(raw) if isinstance(raw, str) else raw
                return gates.check_schema(rescue(reply, page_url) if isinstance(reply, dict) else reply)
            except gates.InvalidDecision as error:
                said = str(error)
        raise Skipped(said, "DecisionError")

    # the loop

    def opening(self) -> Iterator[Event]:
        r, s = self.request, self.state
        yield "crawl_started", r.start_url, {"goal": r.goal, "max_pages": r.max_pages, "max_depth": r.max_depth, "max_results": r.max_results}
        yield "goal_preprocessed", None, {"goal_type": self.goal.goal_type, "anchor_terms": self.goal.anchor_terms, "reference_date": str(self.goal.reference_date) if self.goal.reference_date else None, "source": "fresh"}
        reason = self.blocked(r.start_url)
        if reason:
            s.refused = True
            yield "page_skipped", r.start_url, {"reason": reason, "error_type": "RobotsError"}
            yield self.complete(None)
        else:
            s.push(r.start_url, 0.0, 0)

    def more(self) -> bool:
        """Whether the crawl goes on."""
        r, s = self.request, self.state
        if not s.queue or s.pages >= r.max_pages or (r.max_results is not None and len(s.found) >= r.max_results):
            return False
        s.out_of_time = r.total_timeout is not None and s.clock_ms >= 1000 * r.total_timeout
        return not s.out_of_time

    def step(self) -> Iterator[Event]:
        """Work off the best address of the queue."""
        s = self.state
        _, _, url, depth = heapq.heappop(s.queue)
        norm = normalize(url)
        if norm is None or norm in s.visited:
            return
        s.visited.add(norm)
        s.depth = max(s.depth, depth)
        try:
            reason = self.blocked(url)
            if reason:
                raise Skipped(reason, "RobotsError")
            yield from self.visit(url, norm, depth)
        except Skipped as skip:
            page = None if skip.kind == "RobotsError" else self.look(norm, url)
            yield "page_skipped", self.address(page, url, norm), {"reason": str(skip), "error_type": skip.kind}

    def run(self) -> Iterator[Event]:
        yield from self.opening()
        if not self.state.refused:
            while self.more():
                yield from self.step()
            yield from self.finish()

    @staticmethod
    def address(page: dict | None, url: str, norm: str) -> str:
        """Where a page was found: where it was redirected to, else as it was asked for."""
        final = (page or {}).get("final_url")
        return final if final and normalize(final) != norm else url

    def visit(self, url: str, norm: str, depth: int) -> Iterator[Event]:
        r, s, goal = self.request, self.state, self.goal
        page = self.fetch(norm, url)
        here = self.address(page, url, norm)
        s.pages += 1
        yield "page_fetched", here, {"depth": depth, "http_status": page["status"], "fetch_ms": page.get("fetch_ms")}
        if not 200 <= page["status"] < 300:
            raise Skipped(f"http_{page['status']}")
        if is_document(here):
            yield from self.take_document(here, page)
            return
        title, text, links, ranked, scores = self.read(page, here)
        yield "links_ranked", here, {"total_links": len(ranked), "top_links": [{"url": u, "score": v} for u, v in ranked[:TOP_LINKS]]}
        yield "candidates_extracted", here, {"candidates": self.extracted(text, links)}
        yield "model_evaluating", here, {}
        decision = self.decide(norm, here)
        flags = gates.flags(decision, text, goal.goal_type)
        if flags:
            names = {n for n, _ in flags}
            if "zero_links_no_path" in names:
                page = self.fetch(norm, url)
                here = self.address(page, url, norm)
                title, text, links, ranked, scores = self.read(page, here)
            yield "model_evaluating", here, {}
            decision = self.decide(norm, here)
            flags = gates.flags(decision, text, goal.goal_type)
            if flags:
                raise Skipped(f"Plausibility (model: found={decision.found}, conf={decision.confidence:.2f}): " + "; ".join(d for _, d in flags))
        stands, result_url, follow = gates.accepted(decision, here, title, text, links)
        if stands and result_url is not None and goal.goal_type == "document_link" and is_stale(result_url, goal.reference_date):
            newer = gates.fresher(goal, ranked, s.visited, r.domains, besides=normalize(result_url))
            if newer:
                stands, result_url, follow = False, None, [*follow, *newer]
        s.log.append({"url": here, "depth": depth, "found": stands, "confidence": decision.confidence, "reasoning": decision.reasoning})
        sure = stands and decision.confidence >= r.confidence_threshold
        queued = self.enqueue(follow, ranked, scores, depth)
        if not queued and not s.has_work() and not sure:
            if depth + 1 > r.max_depth:
                s.depth_limit_met = True
            else:
                for link, score in gates.explorable(ranked, visited=s.visited, domains=r.domains, reference=goal.reference_date):
                    s.push(link, score, depth + 1)
                    queued += 1
        yield "model_decision", here, {"found": stands, "confidence": decision.confidence, "links_queued": queued, "reasoning": decision.reasoning, "links_available": len(links), "links_suggested": decision.links_to_follow}
        if sure:
            yield from self.verify(result_url, decision, text, scores, depth)
        elif decision.confidence > s.best_confidence:
            s.best_confidence, s.best_url = decision.confidence, decision.result_url or here

    def read(self, page: dict, here: str) -> tuple:
        title, text, raw = read_page(page.get("html"), here)
        links = rank_by_zone(raw)
        try:
            ranked = self.ranker(links, self.goal)
        except Exception as error:
            raise Skipped(f"ranker: {error}", "InternalError") from error
        return title, text, links, ranked, {normalize(u): v for u, v in ranked}

    def extracted(self, text: str, links: list[dict]) -> list[str]:
        try:
            return [m.value for m in self.extractor(text, links)]
        except Exception:  # a guard: facts are a help to decide, not needed
            return []

    def verified(self, url: str, page: dict | None) -> tuple[bool, float | None, str | None]:
        r = self.request
        try:
            return self.verifier(url, page, self.goal.query_terms, self.goal.goal_type, r.verification, r.verify_threshold)
        except Exception as error:  # a guard: what cannot be verified is rejected
            return False, None, f"verifier_error: {type(error).__name__}"

    def facts(self, text: str, links: list[dict]) -> list[facts.Match]:
        finder = facts.FINDERS.get(self.goal.goal_type)
        if finder:
            return finder(text)
        return facts._documents(text, links, self.goal.regex_hints) if self.goal.goal_type == "document_link" else []

    def enqueue(self, follow: list[str], ranked: list[tuple[str, float]], scores: dict, depth: int) -> int:
        r, s = self.request, self.state
        newer = bool(gates.fresher(self.goal, ranked, s.visited, r.domains))
        n = 0
        for link in follow:
            norm = normalize(link)
            if depth + 1 > r.max_depth:
                s.depth_limit_met = True
            elif norm is not None and norm not in s.visited and (in_domains(host_of(norm), r.domains) or (r.follow_linked_resources and is_document(link))):
                if not (newer and is_stale(link, self.goal.reference_date)):
                    s.push(link, scores.get(norm, 0.0), depth + 1)
                    n += 1
        return n

    def take_document(self, here: str, page: dict) -> Iterator[Event]:
        """A document needs no decision: what is not empty is a result."""
        s = self.state
        s.sent_to_verify += 1
        size = page.get("content_length")
        if page.get("raw_bytes") is not None:
            size = len(page["raw_bytes"])
            passed, reason = size > 0, "empty_response"
        else:
            passed, _, reason = self.verified(here, page)
        if not passed:
            raise Skipped(f"binary_document: {reason}")
        yield self.record(here, 1.0, None, "", size)

    def record(self, url: str, confidence: float, answer: str | None, content: str, size: int | None = None) -> Event:
        s = self.state
        s.found.append({"url": url, "answer": answer, "content": content, "content_length": size})
        return "result_found", url, {"confidence": confidence, "result_index": len(s.found), "answer": answer, "content_length": size}

    def verify(self, url: str, decision: gates.Decision, text: str, scores: dict, depth: int) -> Iterator[Event]:
        r, s = self.request, self.state
        norm = normalize(url)
        page = self.look(norm, url)
        s.sent_to_verify += 1
        passed, score, reason = self.verified(url, page)
        s.verified.append({"url": url, "passed": passed, "score": score, "reason": reason})
        if passed:
            yield self.record(url, decision.confidence, decision.answer, text)
            return
        yield "destination_verification_failed", url, {"score": score, "reason": reason}
        walkable = reason == "html_not_document" or (r.render_js and reason in ("http_401", "http_403"))
        if walkable and depth + 1 <= r.max_depth and norm is not None and norm not in s.visited and in_domains(host_of(norm), r.domains):
            s.push(url, scores.get(norm, 0.0), depth + 1)

    def finish(self) -> Iterator[Event]:
        r, s = self.request, self.state
        exhausted = (s.pages >= r.max_pages and bool(s.queue)) or s.depth_limit_met or s.out_of_time
        if not s.found and exhausted:
            yield "budget_exhausted", None, {"pages_visited": s.pages, "depth_reached": s.depth, "best_candidate": s.best_url}
        failure = None
        if not s.found:
            failure = "all_candidates_rejected" if s.sent_to_verify else "budget_exhausted" if exhausted else None
        yield self.complete(failure, exhausted)

    def complete(self, failure: str | None, exhausted: bool = False) -> Event:
        s = self.state
        found = bool(s.found)
        held = [e["confidence"] for e in s.log if e["found"] or not found]
        return "crawl_complete", None, {
            "found": found, "result_count": len(s.found), "result_urls": [x["url"] for x in s.found], "answers": [x["answer"] for x in s.found] if found else None,
            "content": [x["content"] for x in s.found] if self.request.return_content else None, "confidence": max(held, default=0.0), "pages_visited": s.pages, "depth_reached": s.depth,
            "best_candidate_url": None if found else s.best_url, "budget_exhausted": exhausted, "failure_mode": failure, "visit_log": s.log, "verified_candidates": s.verified,
            "elapsed_ms": s.clock_ms,
        }


def _plain(value: Any) -> Any:
    """None for the missing values that a table gives."""
    return None if value is None or (not isinstance(value, list | tuple | dict) and value is not pd.NaT and value != value) or value is pd.NaT else value


def robots_test(files: dict[str, dict]) -> Callable[[str], str | None]:
    """Why a URL must not be fetched, from robots files by host (status, body, error); a host without one is closed."""
    rules = {host: robots.parse(f.get("body") or "") for host, f in files.items()}

    def blocked(url: str) -> str | None:
        host = host_of(url)
        said = robots.policy_of(files[host].get("status"), files[host].get("error")) if host in files else "blocked:unreachable"
        if said != "parse":
            return None if said == "unrestricted" else said
        found = rules[host][0]
        return "blocked:unparsable" if found is None else None if found.can_fetch(robots.AGENT, url) else "disallowed"

    return blocked


def _parts(rows: pd.DataFrame) -> tuple[Request | None, dict[str, dict], dict[str, list], dict[str, dict]]:
    """Request, snapshots, replies and robots files of one crawl's rows: kind, norm_url, attempt, body (JSON)."""
    request, snapshots, replies, files = None, {}, {}, {}
    for kind, norm, attempt, body in rows.sort_values(["kind", "norm_url", "attempt", "body"], na_position="first")[["kind", "norm_url", "attempt", "body"]].itertuples(index=False):
        if kind == "request":
            fields = {k: v for k, v in json.loads(body).items() if v is not None}
            if "today" in fields:
                fields["today"] = date.fromisoformat(fields["today"])
            request = Request(**fields)
        elif kind == "page":
            snapshots.setdefault(norm, json.loads(body))
        elif kind == "robots":
            files.setdefault(norm, json.loads(body))
        else:
            replies.setdefault(norm, []).append(_plain(body))
    return request, snapshots, replies, files


class _Teller:
    """Numbers and times a crawl's events."""

    def __init__(self, crawl: Crawl, seq: int = 0):
        self.crawl, self.seq, self.rows = crawl, seq, []

    def tell(self, events: list[Event]) -> None:
        r = self.crawl.request
        now = datetime.combine(r.today or date(1970, 1, 1), datetime.min.time(), UTC) + timedelta(milliseconds=self.crawl.state.clock_ms)
        for kind, url, payload in events:
            self.rows.append((r.crawl_id, self.seq, kind, now.isoformat(), url, json.dumps(payload, ensure_ascii=False)))
            self.seq += 1


EVENT_COLUMNS = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]


def replay_group(crawl_id: str, rows: pd.DataFrame, **plugins: Any) -> pd.DataFrame:
    """Events of one crawl from its rows: kind (request, page, reply or robots), norm_url, attempt, body (JSON)."""
    request, snapshots, replies, files = _parts(rows)
    if request is None:
        return pd.DataFrame([], columns=EVENT_COLUMNS)
    if files:
        plugins.setdefault("blocked", robots_test(files))
    crawl = Crawl(request, snapshots, replies, **plugins)
    teller = _Teller(crawl)
    for event in crawl.run():
        teller.tell([event])
    return pd.DataFrame(teller.rows, columns=EVENT_COLUMNS)


class RoundCrawl(Crawl):
    """A crawl that is given snapshots as it asks for them; between rounds it is a few pickled fields."""

    def __init__(self, request: Request, replies: dict[str, list], files: dict[str, dict], **plugins: Any):
        if files:
            plugins.setdefault("blocked", robots_test(files))
        super().__init__(request, {}, replies, **plugins)
        self.files, self.known, self.absent = files, {}, set()

    def look(self, norm: str, url: str) -> dict | None:
        if norm in self.absent:
            return None
        if norm not in self.known:
            raise Wanted(norm, url)
        return self.known[norm]

    def dump(self) -> bytes:
        return pickle.dumps((self.request, self.replies, self.files, self.goal, self.state, self.known, self.absent))

    @classmethod
    def load(cls, data: bytes, **plugins: Any) -> RoundCrawl:
        request, replies, files, goal, state, known, absent = pickle.loads(data)
        out = cls(request, replies, files, **{**plugins, "goal": goal})
        out.state, out.known, out.absent = state, known, absent
        return out

    def ahead(self, first: Wanted) -> list[tuple[str, str]]:
        """The address that is needed and those that come next if it has no snapshot."""
        out = {first.norm: first.url}
        if first.norm in self.state.visited:  # a page to visit, not a destination to verify
            for _, _, url, _ in heapq.nsmallest(ASK_AHEAD - 1, self.state.queue):
                norm = normalize(url)
                if norm is not None and norm not in self.state.visited and norm not in self.absent:
                    out.setdefault(norm, url)
        return list(out.items())

    def advance(self, teller: _Teller) -> list[tuple[str, str]]:
        """Go on as far as the known snapshots reach; returns the addresses that are needed, none at the end."""
        while not self.state.refused and self.more():
            before = pickle.dumps((self.state, self.replies))
            try:
                events = list(self.step())
            except Wanted as wanted:
                asked = self.ahead(wanted)
                self.state, self.replies = pickle.loads(before)
                return asked
            teller.tell(events)
            self.known.clear()
        if not self.state.refused:
            teller.tell(list(self.finish()))
        return []


def _round_rows(crawl: RoundCrawl, teller: _Teller) -> list[tuple]:
    wanted = crawl.advance(teller)
    rows = [(*row, None, None) for row in teller.rows]
    if wanted:
        rows.append((crawl.request.crawl_id, teller.seq, None, None, None, None, crawl.dump(), [{"norm_url": n, "url": u} for n, u in wanted]))
    return rows


def _requests_and_replies(requests: DataFrame, replies: DataFrame, robots_files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What crawls need beside snapshots, as rows of kind, norm_url, attempt and body; and their domains."""
    from pagelens.functions.urls import start_domain_expr

    fields = [c for c in requests.columns if c in Request.__dataclass_fields__]
    asked = requests.select("crawl_id", F.lit("request").alias("kind"), F.lit(None).cast("string").alias("norm_url"), F.lit(0).alias("attempt"), F.to_json(F.struct(*fields), {"dateFormat": "yyyy-MM-dd"}).alias("body"))
    own = F.array(start_domain_expr(F.col("start_url")))
    domains = F.coalesce("allowed_domains", own) if "allowed_domains" in requests.columns else own
    scope = requests.select("crawl_id", F.explode(domains).alias("domain"))
    said = replies.select("crawl_id", F.lit("reply").alias("kind"), "norm_url", F.col("attempt").cast("int"), F.col("raw").alias("body"))
    rows = asked.unionByName(said)
    if robots_files is None:
        return rows, scope
    body = F.to_json(F.struct("status", "body", "error"))
    near = robots_files.withColumn("domain", F.explode(host_suffixes(F.col("host")))).join(scope, "domain").groupBy("crawl_id", "host").agg(F.min(body).alias("body"))
    return rows.unionByName(near.select("crawl_id", F.lit("robots").alias("kind"), F.col("host").alias("norm_url"), F.lit(0).alias("attempt"), "body")), scope


def located(snapshots: DataFrame) -> DataFrame:
    """Snapshots as norm_url, url, h (a hash) and body (JSON)."""
    from pagelens.functions.urls import normalize_udf

    known = [c for c in ("final_url", "status", "fetch_ms", "html", "content_length", "redirects", "error") if c in snapshots.columns]
    rows = snapshots.select(normalize_udf(F.col("url")).alias("norm_url"), "url", F.to_json(F.struct(*known)).alias("body")).filter("norm_url IS NOT NULL")
    return rows.withColumn("h", F.xxhash64("body"))


def group_rows(requests: DataFrame, snapshots: DataFrame, replies: DataFrame, robots_files: DataFrame | None = None) -> DataFrame:
    """One table of all that the crawls need, for streams: requests, every snapshot in their domains, their replies.

    robots_files (host, status, body, error), if given, close the hosts and paths that they close, and hosts that have none.

    requests: the fields of :class:`Request`; snapshots: url, final_url, status, fetch_ms, html, content_length,
    redirects, error; replies: crawl_id, norm_url, attempt, raw. Snapshots meet crawls by an equality join of the host's
    suffixes with the crawls' domains. Of snapshots of one address that with the least url stands.
    """
    rows, scope = _requests_and_replies(requests, replies, robots_files)
    pages = located(snapshots).withColumn("domain", F.explode(host_suffixes(F.expr("lower(try_parse_url(norm_url, 'HOST'))"))))
    seen = pages.join(scope, "domain").groupBy("crawl_id", "norm_url").agg(F.min_by("body", F.struct("url", "h")).alias("body"))
    return rows.unionByName(seen.select("crawl_id", F.lit("page").alias("kind"), "norm_url", F.lit(0).alias("attempt"), "body"))


def crawl_events(requests: DataFrame, snapshots: DataFrame, replies: DataFrame, robots_files: DataFrame | None = None, **plugins: Any) -> DataFrame:
    """crawl_id, seq, type, timestamp, url, payload of all crawls, run in rounds; arguments as for :func:`group_rows`.

    Of snapshots of one address, that whose url was asked for stands, else that with the least url. A crawl's state must
    fit in memory (its request, replies, queue and the page at hand); snapshots are joined, never gathered.
    """
    spark = requests.sparkSession
    shots = save(located(snapshots), "snapshots")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [*EVENT_COLUMNS, "state", "wanted"]

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        request, _, said, files = _parts(rows)
        if request is None:
            return pd.DataFrame([], columns=columns)
        crawl = RoundCrawl(request, said, files, **plugins)
        teller = _Teller(crawl)
        teller.tell(list(crawl.opening()))
        return pd.DataFrame(_round_rows(crawl, teller), columns=columns)

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seq, state, wanted, pos, body in frame[["seq", "state", "wanted", "pos", "body"]].itertuples(index=False):
                crawl = RoundCrawl.load(state, **plugins)
                hit = len(wanted) if _plain(pos) is None else int(pos)
                crawl.absent.update(w["norm_url"] for w in list(wanted)[:hit])
                if hit < len(wanted):
                    crawl.known[wanted[hit]["norm_url"]] = json.loads(body)
                rows += _round_rows(crawl, _Teller(crawl, seq))
            yield pd.DataFrame(rows, columns=columns)

    rows, _ = _requests_and_replies(requests, replies, robots_files)
    done = [save(rows.repartition(tasks, "crawl_id").groupBy("crawl_id").applyInPandas(begin, ROUND_SCHEMA), "crawl-round")]
    while True:
        waiting = done[-1].filter("type IS NULL").select("crawl_id", "seq", "state", "wanted")
        if not waiting.limit(1).count():
            break
        asks = waiting.select("crawl_id", F.posexplode("wanted").alias("pos", "w")).select("crawl_id", "pos", F.col("w.norm_url").alias("norm_url"), F.col("w.url").alias("_asked"))
        best = F.min(F.struct("pos", (F.col("url") != F.col("_asked")).alias("other"), "url", "h", "norm_url")).alias("m")
        hits = asks.join(shots.select("norm_url", "url", "h"), "norm_url").groupBy("crawl_id").agg(best).select("crawl_id", "m.pos", "m.norm_url", "m.url", "m.h")
        pages = hits.join(shots, ["norm_url", "url", "h"]).select("crawl_id", "pos", "body").dropDuplicates(["crawl_id"])  # rows alike
        given = waiting.join(pages, "crawl_id", "left").repartition(tasks, "crawl_id")
        done.append(save(given.mapInPandas(go_on, ROUND_SCHEMA), "crawl-round"))
    return reduce(DataFrame.union, (d.filter("type IS NOT NULL").select(*EVENT_COLUMNS) for d in done))


RESULT_SCHEMA = (
    "found boolean, result_count int, result_urls array<string>, answers array<string>, content array<string>, confidence double, pages_visited int, depth_reached int, best_candidate_url string, "
    "budget_exhausted boolean, failure_mode string, visit_log array<struct<url:string,depth:int,found:boolean,confidence:double,reasoning:string>>, "
    "verified_candidates array<struct<url:string,passed:boolean,score:double,reason:string>>"
)


def results(events: DataFrame) -> DataFrame:
    """One row a crawl, from its last event."""
    last = events.filter("type = 'crawl_complete'").withColumn("r", F.from_json("payload", RESULT_SCHEMA))
    return last.select("crawl_id", "r.*")


def visit_log(found: DataFrame) -> DataFrame:
    """A row for each judged page: crawl_id, visit_no (from 1), url, depth, found, confidence, reasoning."""
    return found.select("crawl_id", F.posexplode("visit_log")).select("crawl_id", (F.col("pos") + 1).alias("visit_no"), "col.*")


def find_link(requests: DataFrame, snapshots: DataFrame, replies: DataFrame) -> DataFrame:
    """crawl_id, found, urls, confidence, pages_visited, best_candidate_url, budget_exhausted, note."""
    every = requests.withColumn("max_results", F.lit(None).cast("int"))
    got = results(crawl_events(every, snapshots, replies))
    stopped = F.format_string("Stopped at a limit after %d page(s), none of which matched; allow more pages or a greater depth to go on.", "pages_visited")
    note = F.when(F.col("found"), None).when(F.col("budget_exhausted"), stopped).otherwise(F.format_string("No matching link on the %d page(s) that were visited.", "pages_visited"))
    return got.select("crawl_id", "found", F.col("result_urls").alias("urls"), "confidence", "pages_visited", "best_candidate_url", "budget_exhausted", note.alias("note"))
