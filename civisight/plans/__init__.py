"""The nine data products, composed from the operators, over landed inputs."""
