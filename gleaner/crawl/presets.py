"""Experiments that are run often: graph, attribute, target value and budget."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    title: str
    graph: tuple[str, ...]
    attribute: tuple[str, ...]
    value: int | str
    budget: int


#: Two samples of one network, by their names in the graph collection.
SAMPLE_SMALL = "vk2-ff20-N10000-A.1611943634"
SAMPLE_LARGE = "vk2-ff40-N100000-A.1612175945"

#: Title, graph, attribute path, value and budget of each experiment.
PRESETS = [
    Preset("donors", ("sel_harv", "donors"), ("comm_56",), 1, 100),
    Preset("livejournal", ("snap", "livejournal"), ("comm_1441",), 1, 1200),
    Preset("dblp", ("snap", "dblp"), ("comm_7556",), 1, 1200),
    Preset("kickstarter", ("sel_harv", "kickstarter"), ("comm_1455",), 1, 700),
    Preset("VK-prog", ("attributed", "vk_10_classes"), ("Программирование",), 1, 1000),
    Preset("VK-busi", ("attributed", "vk_10_classes"), ("Бизнес",), 1, 1000),
    Preset("VK-heal", ("attributed", "vk_10_classes"), ("Здоровье",), 1, 3000),
    Preset("VK-knit", ("attributed", "vk_10_classes"), ("Вязание",), 1, 3000),
    Preset("VK-music", ("attributed", "vk_10_classes"), ("Музыка",), 1, 3000),
    Preset("VK-polit", ("attributed", "vk_10_classes"), ("Политика",), 1, 3000),
    Preset("VK-sport", ("attributed", "vk_10_classes"), ("Спорт",), 1, 3000),
    Preset("VK-phil", ("attributed", "vk_10_classes"), ("Философия",), 1, 3000),
    Preset("VK-cita", ("attributed", "vk_10_classes"), ("Цитаты",), 1, 3000),
    Preset("VK-humor", ("attributed", "vk_10_classes"), ("Юмор",), 1, 3000),
    Preset("VK-sex", ("vk_samples", SAMPLE_SMALL), ("sex",), 1, 1000),
    Preset("VK-sex1", ("vk_samples", SAMPLE_LARGE), ("sex",), 1, 3000),
    Preset("VK-smok1", ("vk_samples", SAMPLE_LARGE), ("personal", "smoking"), 1, 3000),
    Preset("VK-smok3", ("vk_samples", SAMPLE_LARGE), ("personal", "smoking"), 3, 3000),
    Preset("VK-sex2", ("vk_samples", SAMPLE_LARGE), ("sex",), 2, 3000),
    Preset("VK-relat1", ("vk_samples", SAMPLE_LARGE), ("relation",), 1, 3000),
    Preset("TW-occup2", ("attributed", "twitter"), ("occupation",), "2", 3000),
    Preset("TW-occup7", ("attributed", "twitter"), ("occupation",), "7", 3000),
]


def run_preset(catalog, preset: Preset, crawlers: list[str], instances: int, path: str):
    """The stored curves of a preset after what is missing has been crawled; catalog: a GraphCatalog that has the graph and its attribute file."""
    from gleaner.crawl import store
    from gleaner.operators import features as ft
    from gleaner.operators import graph as g

    edges = catalog.get(*preset.graph, giant_only=True)
    head, *keys = preset.attribute
    values = catalog.attribute(*preset.graph, attribute=head, keys=tuple(keys))
    labels = ft.attribute_oracle(g.nodes_of(edges).join(values, "id", "left"), "value", str(preset.value))
    return store.run_missing(catalog.spark, preset.title, edges, labels, crawlers, instances, preset.budget, path)
