"""provscan.operators"""
