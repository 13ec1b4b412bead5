"""One analysis from events to stories, as tables that later reads share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame

from logvigil.config import Thresholds
from logvigil.operators.correlate import assign_components, incident_entities, roll_up
from logvigil.operators.reports import evidence_sample
from logvigil.operators.rules import (EVIDENCE, Finding, Shared, evidence_ends, evidence_sizes, first_mentions, number_alerts, own_evidence,
                                      run_rules, shared_evidence, union_alerts)
from logvigil.operators.scoring import score_entities
from logvigil.operators.story import recommendations, story_steps, with_summary
from logvigil.session import settled


@dataclass
class Analysis:
    """Alerts carry ``incident_id``; lists of unbounded length are long tables of their own."""

    events: DataFrame
    findings: dict[str, Finding]
    alerts: DataFrame
    incidents: DataFrame
    incident_entities: DataFrame
    entities: DataFrame

    @cached_property
    def own_evidence(self) -> DataFrame:
        """The evidence that alerts do not share, written on first use."""
        return settled(own_evidence(self.findings), "evidence")

    @property
    def shared(self) -> list[Shared]:
        return shared_evidence(self.findings)

    @property
    def evidence(self) -> DataFrame:
        """Long evidence table of all alerts. What they share is paired where it is read, and never written in between."""
        return reduce(DataFrame.unionByName, [part.pairs().select(*EVIDENCE) for part in self.shared], self.own_evidence)

    @cached_property
    def evidence_ends(self) -> DataFrame:
        """The evidence that can be shown of an alert, written on first use; its size does not grow with what alerts share."""
        return settled(evidence_ends(self.findings), "evidence-ends")

    @cached_property
    def evidence_sizes(self) -> DataFrame:
        return settled(evidence_sizes(self.findings), "evidence-sizes")

    @cached_property
    def first_mentions(self) -> DataFrame:
        """The evidence that names an event first in its incident, written on first use."""
        return settled(first_mentions(self.findings), "first-mentions")

    def evidence_sample(self) -> DataFrame:
        return evidence_sample(self.alerts, self.evidence_ends, self.evidence_sizes)

    def story(self) -> DataFrame:
        return story_steps(self.alerts)

    def cards(self) -> DataFrame:
        """Incidents with entity lists, title, summary and recommendation."""
        return (with_summary(self.incidents, self.incident_entities)
                .join(recommendations(self.alerts), "incident_id", "left"))


def analyse(events: DataFrame, cfg: Thresholds) -> Analysis:
    """Runs rules, scoring and correlation. Alerts and incidents are written once on the way.

    Events are stored by type first, so that a rule opens only the files of the types it looks at.
    """
    events = settled(events, "events", "type")
    findings = run_rules(events, cfg)
    numbered = number_alerts(union_alerts(findings))
    placed = settled(assign_components(numbered, events, cfg), "components")
    incidents = settled(roll_up(placed, cfg), "incidents")
    alerts = settled(placed.join(incidents.select("component", "incident_id", "incident_no"), "component"), "placed")
    return Analysis(events, findings, alerts, incidents.drop("component"), incident_entities(alerts),
                    score_entities(alerts, cfg))
