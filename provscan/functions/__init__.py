"""provscan.functions"""
