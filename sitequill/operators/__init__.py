"""DataFrame operators over content, settings, requests and artefacts."""
