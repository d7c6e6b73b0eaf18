"""Models for the command line's tests, as ``--models tests.some_models:make``."""

import json

from mapwright.operators.extract import Gazetteer, Models


def make(settings, prompts):
    asked = prompts.filled(settings.prompt_variant, "user", {"content": "X"})
    assert asked == "Find names in X" and settings.attempts == 2
    known = Gazetteer({"Zuul": "service", "Kafka": "queue", "the new gateway": "service"})

    def resolver(request):
        return json.dumps({"resolved": [{"article_name": n["name"], "canonical_name": "Zuul"} for n in json.loads(request)["names"] if n["name"] == "the new gateway"]})

    def reviewer(phrases):
        return "Sure: {'resolved': [{'phrase': 'zaps', 'canonical': 'calls'}]}" if "zaps" in phrases else "{}"

    return Models((known,), (reviewer,), (resolver,))


def broken(settings, prompts):
    def fail(text):
        raise RuntimeError("no answer")

    return Models((fail,))
