"""Syncs of whole landed inventories: what is not whole stops before anything is changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from shelfmark.operators import people as ppl
from shelfmark.operators.content import ContentSource
from shelfmark.operators.reconcile import Reconciled, sync_provider
from shelfmark.schemas import Catalog
from shelfmark.session import materialise
from shelfmark.sources import drive, gate, mail, photos


def _stop_on(problems: DataFrame) -> None:
    wrong = problems.first()
    if wrong is not None:
        raise RuntimeError(f"{wrong['problem']}: {wrong[0]}")


def sync_listings(listings: DataFrame, user: str, catalog: Catalog, now: datetime,
                  content: DataFrame | ContentSource | None = None,
                  provider: str = "nextcloud") -> Reconciled:
    """Sync a directory tree from its landed listings (listing_path, body)."""
    _stop_on(drive.listing_problems(listings, user))
    return sync_provider(drive.drive_facts(listings, user, provider), catalog, now, content,
                         complete=True)


def sync_listing_files(spark: SparkSession, path: str, user: str, catalog: Catalog, now: datetime,
                       content: DataFrame | ContentSource | None = None,
                       provider: str = "nextcloud", listing: Column | None = None) -> Reconciled:
    """Sync a directory tree from landed listing files of any size, read entry by entry."""
    rows = drive.read_entries(spark, path, listing)
    _stop_on(drive.file_problems(rows, drive.listing_files(spark, path, listing), user))
    return sync_provider(drive.entry_facts(rows, user, provider), catalog, now, content,
                         complete=True)


def sync_photo_pages(pages: DataFrame, catalog: Catalog, now: datetime,
                     content: DataFrame | ContentSource | None = None) -> Reconciled:
    """Sync photos from the landed pages of one inventory."""
    _whole(photos.page_chain(pages))
    return sync_provider(photos.photo_facts(pages), catalog, now, content, complete=True)


def sync_message_pages(pages: DataFrame, metadata: DataFrame, catalog: Catalog, now: datetime,
                       content: DataFrame | ContentSource | None = None) -> Reconciled:
    """Sync messages from the landed id pages of one inventory and the messages' metadata; a
    listed message whose metadata is missing or unusable stops the sync."""
    _whole(mail.page_chain(pages))
    facts = materialise(mail.message_facts(pages, metadata), "message-facts")
    return sync_provider(facts, catalog, now, content, complete=True)


def sync_people_pages(pages: DataFrame, persons: DataFrame, sources: DataFrame, now: datetime,
                      provider: str = "immich") -> ppl.People:
    """Sync people from the landed pages of one inventory."""
    _whole(photos.people_chain(pages), constant_total=True)
    inventory = materialise(photos.people_inventory(pages), "people-inventory")
    _stop_on(ppl.inventory_violations(inventory).selectExpr("external_id", "violation AS problem"))
    return ppl.reconcile_people(provider, inventory, persons, sources, now)


def sync_relation_pages(pages: DataFrame, catalog: Catalog, sources: DataFrame,
                        relations: DataFrame, now: datetime, provider: str = "immich"
                        ) -> ppl.Relations:
    """Sync who is seen where from landed pages, one chain of pages per person. Every active
    person needs a chain of pages: one without would lose all relations."""
    links = photos.page_chain(pages, ["personId"])
    _whole(links)
    unseen = ppl.active_person_ids(sources, provider).join(
        pages.selectExpr("personId AS external_id").distinct(), "external_id", "left_anti")
    _stop_on(unseen.selectExpr("external_id", "'person without pages' AS problem"))
    return ppl.reconcile_relations(provider, photos.observed_pairs(pages), catalog, sources,
                                   relations, now)


def _whole(links: DataFrame, constant_total: bool = False) -> None:
    if not gate.is_complete(links, constant_total=constant_total):
        raise RuntimeError("the landed pages are not a whole inventory")
