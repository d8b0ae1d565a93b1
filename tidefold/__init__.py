"""Continuous-time state over unreliable event logs, planned by Catalyst."""
