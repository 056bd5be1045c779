"""Particle, halo and sky-map analytics as DataFrame programs."""
