"""Agent memory and tiered document retrieval as DataFrame plans."""
